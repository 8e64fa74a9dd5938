"""Files in the shared folder, opened by the file system that its address names."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_system(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in address and not address.startswith("file:"):
        return pafs.LocalFileSystem(), address
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address)


def write_whole(address: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it: readers never see a part."""
    system, path = open_system(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part", compression=None) as out:
        out.write(data)
    system.move(part, path)

