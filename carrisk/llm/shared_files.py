"""Files of tasks in the shared folder, by URI: local, or any store pyarrow can open."""

from __future__ import annotations


def filesystem(uri: str):
    """(pyarrow filesystem, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    files, path = filesystem(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(path)


def open_input(uri: str):
    files, path = filesystem(uri)
    return files.open_input_file(path)
