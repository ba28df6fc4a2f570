"""Files that tasks write to the shared folder: temporary names first, then one commit by manifest.

A task writes under a name that no other attempt uses, so a lost executor or a second attempt of a task
harms nothing. The commit renames only what the manifest lists, and can be taken up again where it stopped.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs

PENDING, DONE = "_manifest.pending.json", "_manifest.json"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI such as file:///a, hdfs://host/a or s3://bucket/a."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def exists(uri: str) -> bool:
    s, path = store(uri)
    return s.get_file_info(path).type != fs.FileType.NotFound


def temporary(root: str) -> str:
    return f"{root}/_tmp/{uuid.uuid4().hex}"


def create(uri: str):
    s, path = store(uri)
    s.create_dir(path.rpartition("/")[0], recursive=True)
    return s.open_output_stream(path, compression=None)


def open_map(uri: str):
    """A random-access file; memory-mapped where the file is local, so that reads copy nothing."""
    s, path = store(uri)
    if isinstance(s, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path)
    return s.open_input_file(path)


def _put(uri: str, text: str) -> None:
    with create(uri) as f:
        f.write(text.encode())


def _get(uri: str) -> dict:
    s, path = store(uri)
    with s.open_input_stream(path) as f:
        return json.loads(f.read())


def commit(root: str, entries: list[dict], **more) -> dict:
    """Gives every entry's file its final name; entries have tmp (a URI) and name. Returns the manifest."""
    _put(f"{root}/{PENDING}.tmp", json.dumps({"files": entries, **more}))
    s, at = store(root)
    s.move(f"{at}/{PENDING}.tmp", f"{at}/{PENDING}")
    return resume(root)


def resume(root: str) -> dict:
    """Finishes a commit that may have been interrupted at any point."""
    s, at = store(root)
    if not exists(f"{root}/{PENDING}"):
        return _get(f"{root}/{DONE}")
    manifest = _get(f"{root}/{PENDING}")

    def rename(entry: dict) -> None:
        tmp = store(entry["tmp"])[1]
        if s.get_file_info(tmp).type != fs.FileType.NotFound:
            s.move(tmp, f"{at}/{entry['name']}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, manifest["files"]))
    if exists(f"{root}/_tmp"):
        s.delete_dir(f"{at}/_tmp")
    s.move(f"{at}/{PENDING}", f"{at}/{DONE}")
    return manifest
