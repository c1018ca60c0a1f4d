"""Files by local path or URI (hdfs://, s3://, gs://, file://): opened, listed and read by range."""

from __future__ import annotations

import os
from typing import BinaryIO


def is_uri(path: str) -> bool:
    return "://" in path


def _remote(path: str):  # noqa: ANN202
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path.replace("%", "%25"))  # names hold % themselves


def open_file(path: str) -> BinaryIO:
    """For reading, with seek."""
    if not is_uri(path):
        return open(path, "rb")
    system, name = _remote(path)
    return system.open_input_file(name)


def exists(path: str) -> bool:
    if not is_uri(path):
        return os.path.exists(path)
    from pyarrow.fs import FileType

    system, name = _remote(path)
    return system.get_file_info(name).type != FileType.NotFound


def size(path: str) -> int:
    """In bytes; FileNotFoundError if it is no file."""
    if not is_uri(path):
        return os.path.getsize(path)
    from pyarrow.fs import FileType

    system, name = _remote(path)
    info = system.get_file_info(name)
    if info.type != FileType.File:
        raise FileNotFoundError(path)
    return info.size


def names(folder: str) -> list[str]:
    """What a folder holds."""
    if not is_uri(folder):
        return os.listdir(folder)
    from pyarrow.fs import FileSelector

    system, name = _remote(folder)
    return [i.base_name for i in system.get_file_info(FileSelector(name))]


def real(path: str) -> str:
    """One name for a file: links resolved, or the URI without ``.`` and ``..``. FileNotFoundError if it is not there."""
    if not is_uri(path):
        return os.path.realpath(path, strict=True)
    scheme, _, rest = path.partition("://")
    out = f"{scheme}://{os.path.normpath(rest)}"
    if not exists(out):
        raise FileNotFoundError(path)
    return out


def absolute(path: str) -> bool:
    return is_uri(path) or os.path.isabs(path)


class Ranged:
    """A file that reads like bytes, a block at a time: only what is sliced is fetched."""

    BLOCK = 1 << 20

    def __init__(self, path: str) -> None:
        self.file, self.length = open_file(path), size(path)
        self.at, self.block = 0, b""

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, key: slice) -> bytes:
        start, stop, _ = key.indices(self.length)
        if start >= stop:
            return b""
        if not self.at <= start or stop > self.at + len(self.block):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(max(stop - start, self.BLOCK))
        return self.block[start - self.at : stop - self.at]

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
