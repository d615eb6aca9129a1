"""Binary files in the shared folder, opened by tasks through their file system's URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Yield (URI, stream) of a file no other attempt writes to.

    A task that fails leaves an orphan; only files that a committed manifest names are ever read.
    """
    where, root = _at(folder)
    where.create_dir(root, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with where.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
        yield f"{folder}/{name}", out


def open_stream(uri: str):
    where, path = _at(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_file(uri: str):
    where, path = _at(uri)
    return where.open_input_file(path)
