"""Files that tasks write to and read from the shared folder, by path or URI."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(folder: str, name: str, *parts: bytes) -> str:
    """Written under another name first, so that a reader never sees half a file. Returns the URI."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as out:
        for p in parts:
            out.write(p)
    system.move(temporary, f"{path}/{name}")
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def save_array(folder: str, name: str, a: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, a)
    write_file(folder, name, out.getbuffer())


def map_array(folder: str, name: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted; read where it is an object store."""
    system, path = locate(folder)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(f"{path}/{name}", mmap_mode="r")
    return np.load(io.BytesIO(read_file(f"{folder}/{name}")))
