"""Addresses as Spark writes them, for readers and writers of bytes in tasks."""

from __future__ import annotations

import pyarrow.fs

#: Spark's names of stores whose files another name reaches here.
SAME = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def filesystem(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address and the path on it; an address without a scheme is a local path."""
    scheme, mark, rest = address.partition(":")
    if not mark or "/" in scheme or scheme == "file":
        path = rest if mark and scheme == "file" else address
        return pyarrow.fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else path
    return pyarrow.fs.FileSystem.from_uri(f"{SAME.get(scheme, scheme)}:{rest}")
