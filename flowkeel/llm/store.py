"""Files in the shared folder: written whole or not at all, read by any executor."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder; a plain path is local to a shared mount."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list[bytes | np.ndarray]) -> None:
    """Writes under another name, then renames: a task that runs twice leaves one whole file."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part.tobytes() if isinstance(part, np.ndarray) else part)
    system.move(own, path)


def map_file(uri: str) -> memoryview:
    """The file's bytes: memory-mapped on a mounted folder, else read once."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return memoryview(f.read_buffer(f.size()))


def exists(uri: str) -> bool:
    system, path = open_fs(uri)
    return system.get_file_info(path).type == fs.FileType.File


def delete_file(uri: str) -> None:
    system, path = open_fs(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)
