"""Path, glob and URI columns."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_segment(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """Directory part without trailing slash; '' for a top-level entry."""
    return F.regexp_replace(_col(path), r"/?[^/]*\z", "")


def depth(path: Column | str) -> Column:
    """Number of path components."""
    return F.size(F.split(_col(path), "/"))


def is_hidden(path: Column | str) -> Column:
    """An entry is hidden by its own name alone, not by a hidden parent."""
    return last_segment(path).startswith(".")


def extension(path: Column | str) -> Column:
    """Text after the last dot of the name; null if there is none. A leading dot starts a
    name, not an extension, while a trailing dot gives ''."""
    pattern = r"(?s)\A.+\.([^.]*)\z"
    name = last_segment(path)
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def relative_to(path: Column | str, root: str) -> Column:
    """``path`` below ``root``; a path elsewhere is returned unchanged."""
    prefix = root.rstrip("/") + "/"
    c = _col(path)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def under(root: str, path: Column | str) -> Column:
    """Destination of a relative path below ``root``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), _col(path))


def ancestors(path: Column | str) -> Column:
    """Every directory above ``path``, top-level first (array of strings)."""
    parts = F.split(_col(path), "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))


def _class_to_regex(glob: str, at: int) -> tuple[str, int]:
    """Regex of the character class that opens at ``glob[at]`` and the index after it."""
    end = at + 1
    negated = end < len(glob) and glob[end] in "!^"
    if negated:
        end += 1
    start = end
    while end < len(glob) and (glob[end] != "]" or end == start):
        end += 1
    if end >= len(glob):
        raise ValueError(f"unclosed character class in glob {glob!r}")
    members = re.sub(r"([\\\[\]^&~|])", r"\\\1", glob[start:end])
    return f"[{'^' if negated else ''}{members}]", end + 1


def glob_to_regex(glob: str) -> str:
    """Anchored regex for a glob over the whole relative path.

    ``*`` and ``?`` also match ``/``; ``**/``, ``/**`` and ``/**/`` match any number of
    directories, including none; ``{a,b}`` alternates; ``[!a]`` negates; ``\\`` escapes.
    """
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("/**/", i):
            out.append("(?:/|/.*/)")
            i += 4
        elif i == 0 and glob.startswith("**/"):
            out.append("(?:/?|.*/)")
            i += 3
        elif glob[i:] == "/**":
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append(".*")
            i += 1
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            text, i = _class_to_regex(glob, i)
            out.append(text)
        elif c == "{":
            braces += 1
            out.append("(?:")
            i += 1
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
            i += 1
        elif c == "," and braces:
            out.append("|")
            i += 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    if braces:
        raise ValueError(f"unclosed alternation in glob {glob!r}")
    return r"\A(?s:" + "".join(out) + r")\z"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    tests = [_col(path).rlike(glob_to_regex(g)) for g in globs]
    return functools.reduce(operator.or_, tests, F.lit(False))


#: Pattern texts shared by the column functions and the SQL functions.
OBJECT_URL = r"(?s)\As3://([^/]*)/?(.*)\z"
REMOTE_PATH = r"(?s)\A([^@:]*)@([^:]*):(.*)\z"


def _groups(c: Column, pattern: str, names: list[str]) -> Column:
    fields = [F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(c.rlike(pattern), F.struct(*fields))


def split_object_url(url: Column | str) -> Column:
    """struct(bucket, key) of ``s3://bucket/key``; null for anything else."""
    return _groups(_col(url), OBJECT_URL, ["bucket", "key"])


def split_remote_path(text: Column | str) -> Column:
    """struct(user, host, path) of ``user@host:path``; null for anything else."""
    return _groups(_col(text), REMOTE_PATH, ["user", "host", "path"])
