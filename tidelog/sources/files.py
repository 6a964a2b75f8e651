"""Files in the shared folder, read and written from tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager


def opened(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written_whole(uri: str) -> Iterator:
    """A stream to a file under another name, renamed at the end, so that a lost or repeated task leaves either
    the whole file or none."""
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside, compression=None) as out:
        yield out
    system.move(aside, path)


def write_whole(uri: str, pieces: Iterable) -> int:
    """Writes a file as `written_whole` does. Returns its bytes."""
    n = 0
    with written_whole(uri) as out:
        for piece in pieces:
            out.write(piece)
            n += len(piece)
    return n


def write_new(uri: str, data: bytes) -> None:
    """Writes a file that is not there yet, whole or not at all; FileExistsError if another has written it. On a local
    disk a link decides, elsewhere a renaming that does not replace, as in HDFS; where renaming replaces, one writer at a time."""
    from pyarrow import fs

    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(data)
    if isinstance(system, fs.LocalFileSystem):
        try:
            os.link(aside, path)
        finally:
            os.unlink(aside)
    elif system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(aside)
        raise FileExistsError(uri)
    else:
        system.move(aside, path)


def read_whole(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read()
