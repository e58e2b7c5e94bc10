"""Reading and writing plain files of the shared folder from Python tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3 and what else pyarrow knows) or of a local path."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def write(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a reader sees all of a file or none, a retry replaces it by the same."""
    where, path = at(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, path)


def read(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    where, path = at(uri)
    with where.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size) if size is not None else f.read()
