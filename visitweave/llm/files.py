"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (or an absolute path)."""
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name no other attempt of a task uses; only files named in a finished manifest are read."""
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """Open a new file for writing, with its folders."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_file(uri: str):
    """Open a file for reading at any place."""
    system, path = locate(uri)
    return system.open_input_file(path)
