"""Whole files in the shared folder, written and read inside tasks through the file system its URI names."""

from __future__ import annotations

import uuid


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Replacing:
    """A new file that takes its name only once it is complete, so that a task may be run again at any time."""

    def __init__(self, folder: str, name: str) -> None:
        self.system, path = _place(folder)
        self.system.create_dir(path, recursive=True)
        self.name, self.final, self.draft = name, f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> int:
        self.stream.close()
        self.system.move(self.draft, self.final)
        return self.size


def open_for_reading(folder: str, name: str):
    system, path = _place(folder)
    return system.open_input_stream(f"{path}/{name}", compression=None)
