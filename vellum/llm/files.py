"""Binary files in the shared folder, for executors: written whole, read by range.

A task writes under a name of its own and then moves the file to its final name, so that a task that runs again, after
an executor is lost, replaces the file by an equal one and a half-written file is never read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_folder(uri: str):
    """(file system, path) of any address that Arrow knows: file, hdfs, s3, gs."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def write_whole(folder: str, name: str):
    """A stream to ``folder``/``name`` that comes into being when the block ends well."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(own) as out:
            yield out
    except BaseException:
        system.delete_file(own)
        raise
    system.move(own, f"{path}/{name}")


class Ranges:
    """Range reads from files of one folder; a few stay open."""

    def __init__(self, folder: str, keep: int = 16):
        self.system, self.path = open_folder(folder)
        self.keep, self.open = keep, {}
        self.ahead: tuple[str, int, bytes] = ("", 0, b"")

    def read_on(self, name: str, at: int, size: int, ahead: int = 1 << 20) -> bytes:
        """A range like that of read(), where the next ones will follow soon: they are read together."""
        held, begin, data = self.ahead
        if held != name or not begin <= at <= at + size <= begin + len(data):
            begin, data = at, self.read(name, at, max(size, ahead))
            self.ahead = (name, at, data)
        return data[at - begin : at - begin + size]

    def read(self, name: str, at: int, size: int) -> bytes:
        file = self.open.pop(name, None) or self.system.open_input_file(f"{self.path}/{name}")
        self.open[name] = file
        if len(self.open) > self.keep:
            self.open.pop(next(iter(self.open))).close()
        return file.read_at(size, at)

    def size(self, name: str) -> int:
        return self.system.get_file_info(f"{self.path}/{name}").size
