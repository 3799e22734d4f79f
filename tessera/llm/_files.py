"""Files written by tasks into the shared folder, on any file system that pyarrow can open."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a uri; a path without scheme is local."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def create(folder: str, suffix: str) -> tuple[str, object]:
    """(uri, output stream) of a new file below ``folder``.

    Names are never reused, so a task that is run again leaves its earlier
    file unread: readers go by the manifest, which Spark commits.
    """
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def read_stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)
