"""Whole small files on whatever file system a URI names, for tasks that write or read binary formats."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


@contextlib.contextmanager
def publish(uri: str):
    """A binary stream whose file appears under its name only when complete; a task that dies leaves no half file there."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary, compression=None) as out:
        yield out
    system.move(temporary, path)


def open_at(uri: str):
    """A seekable binary file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read(uri: str) -> bytes:
    with open_at(uri) as f:
        return f.read()
