"""Files of the shared folder by URI: the local file system for plain paths and file:, pyarrow's file systems otherwise."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local(uri: str) -> str | None:
    """The local path of a plain path or a file: URI, else None."""
    p = urlparse(uri)
    if p.scheme == "file":
        return unquote(p.path)
    return uri if not p.scheme else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    if (p := local(uri)) is not None:
        os.makedirs(p, exist_ok=True)
    else:
        f, p = _remote(uri)
        f.create_dir(p, recursive=True)


def write(uri: str, data: bytes) -> None:
    """Writes whole files: a local one under another name first, so that no reader sees a part."""
    if (p := local(uri)) is not None:
        with open(p + ".tmp", "wb") as f:
            f.write(data)
        os.replace(p + ".tmp", p)
    else:
        f, p = _remote(uri)
        with f.open_output_stream(p) as out:
            out.write(data)


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    if (p := local(uri)) is not None:
        with open(p, "rb") as f:
            f.seek(start)
            return f.read(-1 if size is None else size)
    f, p = _remote(uri)
    with f.open_input_file(p) as src:
        src.seek(start)
        return src.read(src.size() - start if size is None else size)


def listing(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below a folder."""
    if (p := local(uri)) is not None:
        return sorted((os.path.join(d, x), os.path.getsize(os.path.join(d, x))) for d, _, names in os.walk(p) for x in names)
    from pyarrow import fs

    f, p = _remote(uri)
    scheme = uri.split(p)[0]
    return sorted((scheme + x.path, x.size) for x in f.get_file_info(fs.FileSelector(p, recursive=True)) if x.is_file)
