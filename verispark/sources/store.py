"""Byte streams of the stores that executors can open themselves."""

from __future__ import annotations

import os
import re


def local_path(path: str) -> str | None:
    """The path without its scheme, if this machine's file system serves it."""
    match = re.match(r"file:/*(/.*)$", path)
    if match:
        return match[1]
    return path if path.startswith("/") else None


def open_input(path: str):
    """A seekable binary stream; reads of a range fetch that range."""
    plain = local_path(path)
    if plain is not None:
        return open(plain, "rb")
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def write_bytes(path: str, content: bytes) -> None:
    """A whole file at once; a repeated attempt writes the same bytes again."""
    plain = local_path(path)
    if plain is None:
        from pyarrow import fs
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as stream:
            stream.write(content)
        return
    os.makedirs(os.path.dirname(plain), exist_ok=True)
    part = f"{plain}.{os.getpid()}.part"
    with open(part, "wb") as stream:
        stream.write(content)
    os.replace(part, plain)
