"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np


def local(path: str) -> str | None:
    """The path on a mounted file system, or None for a remote store."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def open_write(path: str):
    if (place := local(path)) is not None:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        return open(place, "wb")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_output_stream(place)


def read_array(path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted; read from a remote store otherwise."""
    if (place := local(path)) is not None:
        return np.memmap(place, dtype, "r") if os.path.getsize(place) else np.zeros(0, dtype)
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        return np.frombuffer(f.read(), dtype)


def remove(path: str) -> None:
    if (place := local(path)) is not None:
        os.remove(place)
        return
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.delete_file(place)
