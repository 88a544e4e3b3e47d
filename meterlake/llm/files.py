"""Files that executors write and read in the shared folder, through pyarrow's file systems.

``file:``, ``hdfs:``, ``s3:`` and ``gs:`` addresses work alike. A file appears under its final
name only when it is whole, so a task that is lost or run twice leaves no half-written file.
"""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager


def opened(uri: str):
    """The file system of an address and the path in it; a bare path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A binary stream; on success its file takes the place of ``uri``, else it goes."""
    system, path = opened(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft, compression=None) as out:
            yield out
        system.move(draft, path)
    except BaseException:
        if system.get_file_info(draft).is_file:
            system.delete_file(draft)
        raise


def read_whole(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read()


def random_access(uri: str):
    """A seekable binary file."""
    system, path = opened(uri)
    return system.open_input_file(path)
