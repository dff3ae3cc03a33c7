"""Files that tasks write and read themselves, in any store pyarrow can reach by URI."""

from __future__ import annotations

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path behind a URI or an absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)


def drop_folder(uri: str) -> None:
    store, path = open_store(uri)
    store.delete_dir(path)
