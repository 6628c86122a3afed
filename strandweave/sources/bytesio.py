"""Files of any file system that pyarrow knows, opened for ranged reads."""

from __future__ import annotations

import os
from typing import BinaryIO

from pyarrow import fs


def opened(path: str) -> BinaryIO:
    """A seekable binary file; path may be local or a URI."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def size_of(path: str) -> int:
    if "://" not in path:
        return os.path.getsize(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).size


def read_range(path: str, start: int, length: int) -> bytes:
    with opened(path) as f:
        f.seek(start)
        return f.read(length)


def local_path(path: str) -> str | None:
    """The path as the operating system knows it; None for other file systems."""
    if "://" not in path:
        return os.path.abspath(path)
    system, inner = fs.FileSystem.from_uri(path)
    return inner if isinstance(system, fs.LocalFileSystem) else None


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
