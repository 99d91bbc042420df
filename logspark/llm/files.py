"""Binary files in the shared folder: written and read by tasks through any file system that Arrow knows."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str, attempt: int):
    """A file that appears under its name when it is complete; a repeated task puts the same bytes in its place."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    hidden = f"{path.rpartition('/')[0]}/_{attempt}-{path.rpartition('/')[2]}"
    with system.open_output_stream(hidden, compression=None) as out:
        yield out
    system.move(hidden, path)


def read_range(uri: str, offset: int, size: int) -> bytes:
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, offset)
