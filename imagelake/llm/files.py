"""Files that tasks write and read below the shared folder."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Spark path, also where the URI has one slash (file:/x) or none."""
    m = re.match(r"file:/*(/.*)$", uri)
    return (pafs.LocalFileSystem(), m[1]) if m else pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Placed:
    """A file that appears under its name when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.temporary = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        """Where another attempt has put the same file already, that one stays."""
        self.out.close()
        there = self.fs.get_file_info(self.path)
        if there.type == pafs.FileType.File:
            if there.size == self.size:
                self.fs.delete_file(self.temporary)
                return
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)
