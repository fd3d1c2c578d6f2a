"""Files by path or URI from Python, on the file system the URI names; for tasks, which have no JVM."""

from __future__ import annotations

import json

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_bytes(path: str) -> bytes:
    system, at = locate(path)
    with system.open_input_stream(at) as f:
        return f.read()


def objects_of(path: str) -> list:
    """The items of a JSON list, or the document as the only one."""
    doc = json.loads(read_bytes(path).decode("utf-8-sig"))
    return doc if isinstance(doc, list) else [doc]


def names_below(path: str) -> list[str]:
    """Paths of the files in a folder, by name."""
    system, at = locate(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File]
    root = path[: len(path) - len(at)] if path.endswith(at) else "file:" if path.startswith("file:") else ""
    return sorted(root + p for p in found if not p.rsplit("/", 1)[-1].startswith((".", "_")))
