"""Binary files in the shared folder, written and read by executors.

Paths are URIs; pyarrow's file systems open them (local, HDFS and object stores). A file gets
its final name by a move after it is complete, and readers only open files that a written
manifest lists, so a lost or repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream whose bytes get the name ``uri`` when all is written."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(draft, compression=None) as out:
            yield out
        system.move(draft, path)
    except BaseException:
        try:
            system.delete_file(draft)
        except OSError:
            pass
        raise


@contextmanager
def reading(uri: str) -> Iterator:
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as source:
        yield source
