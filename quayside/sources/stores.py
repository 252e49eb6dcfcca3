"""File systems of URIs and mounted paths, as tasks open them."""

from __future__ import annotations

import re
from functools import lru_cache

from pyarrow import fs

#: Names under which Hadoop knows stores that have another scheme of their own.
ALIASES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}
#: Schemes that tasks can open without Spark.
KNOWN = ("file", "s3", "gs", "hdfs", "abfs")


def scheme_of(uri: str) -> str:
    """Scheme of a URI as the stores name it; ``file`` for a mounted path."""
    found = re.match(r"\A([A-Za-z][A-Za-z0-9+.-]*):/", uri)
    return ALIASES.get(found[1], found[1]) if found else "file"


@lru_cache(maxsize=64)
def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path there) of a URI or mounted path, without a slash at the end; opened once per worker."""
    scheme = scheme_of(uri)
    if scheme == "file":
        path = re.sub(r"\Afile:/+", "/", uri)
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    if scheme not in KNOWN:
        raise ValueError(f"tasks cannot open {scheme}:// by themselves")
    place, path = fs.FileSystem.from_uri(re.sub(r"\A[^:]+", scheme, uri.rstrip("/")))
    return place, path.rstrip("/")
