"""Files of sources and sinks, by whatever file system their address names: executors and the driver use the same one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs

#: Bytes that are copied at a time.
BLOCK = 8 << 20


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; a path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:") and not path.startswith("file://"):  # as Hadoop writes it
        path = "file://" + path[5:]
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs, inside.rstrip("/")


def put(path: str, content: bytes) -> None:
    """Writes a file beside its place, then renames it: a reader finds it whole or not at all."""
    fs, p = at(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{p}.part") as f:
        f.write(content)
    fs.move(f"{p}.part", p)


def get(path: str) -> bytes:
    fs, p = at(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def names(path: str) -> list[str]:
    """The files and folders of a folder, in order; none if there is no such folder."""
    fs, p = at(path)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)))


def delete(path: str) -> None:
    """Removes a folder with what is in it, if it is there."""
    fs, p = at(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def blocks(path: str) -> Iterator[bytes]:
    fs, p = at(path)
    with fs.open_input_stream(p) as f:
        while part := f.read(BLOCK):
            yield part
