"""Files of the shared folder, opened inside tasks by URI."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def create(folder: str, name: str, suffix: str):
    """A new file under an attempt's own name: a retried task never touches another attempt's file, and only
    names in the table that the tasks return count.  Returns (uri, stream)."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex[:12]}{suffix}"
    return posixpath.join(folder, file), system.open_output_stream(posixpath.join(path, file), compression=None)


def open_stream(uri: str):
    system, path = place(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
