"""Files by path or URI, read and written from driver or executors."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a URI or a local path, and the path within it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def replace(uri: str, content: bytes) -> None:
    """Write a file whole: readers see what was there before or all of it."""
    system, path = opened(uri)
    with system.open_output_stream(path + ".new", compression=None) as out:
        out.write(content)
    system.move(path + ".new", path)


def file_size(uri: str) -> int:
    system, path = opened(uri)
    return system.get_file_info(path).size


def join(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def files_under(folder: str, ending: str) -> list[tuple[str, int]]:
    """(URI, size) of the files right under ``folder`` with that ending, by name."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((join(folder, i.base_name), i.size) for i in found if i.is_file and i.base_name.endswith(ending))
