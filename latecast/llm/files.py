"""Files that tasks write into and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(folder: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(folder)
    return found, path.rstrip("/")


def start(folder: str, name: str) -> tuple[fs.FileSystem, str, str]:
    """(store, temporary path, final path): a repeated task writes to another temporary name."""
    found, path = store(folder)
    found.create_dir(path, recursive=True)
    return found, f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"


def commit(found: fs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name; what an earlier attempt left there is the same bytes."""
    try:
        found.move(temporary, final)
    except OSError:
        found.delete_file(final)
        found.move(temporary, final)
