"""Files that executors write and read in the shared folder, by URI."""

from __future__ import annotations

import contextlib

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs and what else pyarrow knows)."""
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str):
    """A stream to write to; the file gets its name when all is written, so that a lost or repeated attempt leaves no half of it."""
    system, path = open_fs(uri)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.part"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own) as out:
        yield out
    system.move(own, path)


def open_file(uri: str):
    """A file to read from at any place."""
    system, path = open_fs(uri)
    return system.open_input_file(path)


def stream(uri: str):
    system, path = open_fs(uri)
    return system.open_input_stream(path, compression=None)
