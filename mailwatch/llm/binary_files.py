"""Binary files in a folder that all executors share, written whole and read in ranges by tasks.

Paths are URIs of a file system that pyarrow opens on the executors (file, hdfs, s3, gs, abfs). A file
appears under its name only once it is complete, so a lost or repeated task leaves no torn file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri.removeprefix("file:").lstrip("/")
    elif "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def whole_file(uri: str) -> Iterator[pa.NativeFile]:
    """A stream whose bytes become the file when the block ends well."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    stream = system.open_output_stream(part)
    try:
        yield stream
    except BaseException:
        stream.close()
        system.delete_file(part)
        raise
    stream.close()
    system.move(part, path)


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)
