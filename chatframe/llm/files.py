"""Binary files in the folder all executors share, written and read inside tasks.

Spark has no writer for such files.  A task writes under a name no other attempt uses and
returns what it wrote; only names in the table of a finished job are ever read, so what a
lost or repeated attempt left behind has no effect.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext


def opened(uri: str):
    """The Arrow file system of ``uri`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str):
    """A stream to a new file and its address."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def existing(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
