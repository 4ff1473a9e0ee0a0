"""Which paths of a folder are skipped: heavy directories and the patterns of ignore files, as one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are always skipped.
SKIPPED = (
    "node_modules .git __pycache__ .venv venv env .tox dist build .next .nuxt out .output .cache .parcel-cache coverage "
    ".nyc_output target .mypy_cache .pytest_cache .ruff_cache .idea .vscode eggs .eggs"
).split()


def pattern_regex(pattern: str) -> str:
    """The regular expression of one ignore pattern, to be found in a path relative to the ignore file.

    ``*`` and ``?`` stay within a name, ``**`` crosses names, a slash inside or
    in front ties the pattern to the folder, one at the end asks for a directory.
    """
    directory, body = pattern.endswith("/"), pattern.strip("/")
    tied = "/" in pattern.rstrip("/")
    out = ""
    for token in re.findall(r"/\*\*/|\*\*/|/\*\*$|\*+|\?|\[!?[^\]]+\]|\\.|.", body):
        special = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}
        if token in special:
            out += special[token]
        elif token[0] == "*":
            out += "[^/]*"
        elif token[0] == "[" and len(token) > 2:
            out += "[" + ("^" + token[2:] if token[1] == "!" else token[1:])
        else:
            out += re.escape(token[-1])
    return ("^" if tied else "(?:^|/)") + out + ("/" if directory else "(?:/|$)")


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Whether a relative path is skipped; the last pattern that matches decides, ``!`` takes a path back in.

    A directory that is always skipped can't be taken back.
    """
    parts = F.split(path, "/")
    always = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))) | F.exists(parts, lambda p: p.endswith(".egg-info"))
    found = F.lit(False)
    for p in (p.strip() for p in patterns):
        if p.strip("!/") and not p.startswith("#"):
            found = F.when(path.rlike(pattern_regex(p.removeprefix("!"))), not p.startswith("!")).otherwise(found)
    return F.coalesce(always | found, F.lit(False))
