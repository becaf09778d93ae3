"""Files by path or URI (local, hdfs, s3, ...), with ranged reads: what executors and the driver share."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read(file.size() - start if size is None else size)


def write(uri: str, data: bytes) -> None:
    system, path = place(uri)
    with system.open_output_stream(path) as file:
        file.write(data)


@contextmanager
def writing(uri: str):
    """A function that adds bytes to a new file, which goes again if the block fails."""
    system, path = place(uri)
    try:
        with system.open_output_stream(path) as file:
            yield file.write
    except BaseException:
        remove(uri)
        raise


def replace(uri: str, data: bytes) -> None:
    """Writes under a hidden name beside it and moves that into place."""
    system, path = place(uri)
    folder, name = path.rsplit("/", 1)
    with system.open_output_stream(f"{folder}/.{name}") as file:
        file.write(data)
    if system.get_file_info(path).type != fs.FileType.NotFound and system.type_name != "local":
        system.delete_file(path)
    system.move(f"{folder}/.{name}", path)


def kind(uri: str) -> str:
    """``file``, ``folder`` or ``none``."""
    system, path = place(uri)
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(system.get_file_info(path).type, "none")


def size(uri: str) -> int:
    system, path = place(uri)
    return system.get_file_info(path).size or 0


def names(uri: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    system, path = place(uri)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def make(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def move(uri: str, to: str) -> None:
    system, path = place(uri)
    system.move(path, place(to)[1])


def remove(uri: str) -> None:
    """A file or a whole folder; nothing if it isn't there."""
    system, path = place(uri)
    found = system.get_file_info(path).type
    if found == fs.FileType.Directory:
        system.delete_dir(path)
    elif found == fs.FileType.File:
        system.delete_file(path)
