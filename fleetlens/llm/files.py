"""Files in the cluster's shared folder, reached from the driver and from tasks alike."""

from __future__ import annotations

from pyarrow import fs


def reach(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named with or without a scheme."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a small file; the last writer wins and no reader sees half of it."""
    store, path = reach(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
