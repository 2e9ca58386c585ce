"""Files that tasks write and read themselves, by URI, in whatever store the shared folder lies in."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI (file, hdfs, s3, gs) or absolute path, and the path within it."""
    return pafs.FileSystem.from_uri(uri)


class Written:
    """One file, written once from front to back. Its name holds a fresh id, so a second attempt of a task
    never touches the first one's file; only files that a finished task reports are ever read."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        store, path = open_store(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = store.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_input(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)
