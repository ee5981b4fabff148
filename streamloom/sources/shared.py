"""Files on whatever file system a uri names, for code that runs in tasks and in source readers."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri or plain path, and the path on it."""
    if re.match(r"[a-z][\w+.-]*:/", uri) and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)


def listed(uri: str, recursive: bool = False) -> list[fs.FileInfo]:
    """Files below a folder, in order of their paths; a missing folder is empty."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)


def exists(uri: str) -> bool:
    system, path = opened(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def put(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all: under a hidden name first, then renamed over what is there."""
    system, path = opened(uri)
    folder, name = posixpath.split(path)
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as f:
        f.write(data)
    system.move(hidden, path)


def get(uri: str) -> bytes | None:
    """A small file's content; null if there is none."""
    system, path = opened(uri)
    try:
        with system.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


def put_json(uri: str, value: object) -> None:
    put(uri, json.dumps(value, sort_keys=True).encode())


def get_json(uri: str, default: object = None) -> object:
    data = get(uri)
    return default if data is None else json.loads(data)


def drop(uri: str) -> None:
    """Removes a file or a folder, if it is there."""
    system, path = opened(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def blocks(system: fs.FileSystem, path: str, start: int, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file from ``start`` on."""
    with system.open_input_file(path) as f:
        f.seek(start)
        while data := f.read(size):
            yield data
