"""Text functions as Catalyst expressions: normalising, terms, scores, titles, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-zA-Z0-9_]+"


def normalized(text: Column) -> Column:
    """Lower case with runs of white space as one space, none around."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def content_hash(text: Column) -> Column:
    return F.sha1(normalized(text).cast("binary"))


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of three characters or more, in order."""
    import re

    return list(dict.fromkeys(w for w in re.findall(WORD, query.lower()) if len(w) >= 3))


def terms(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= least))


def keyword_score(content: Column, tags: Column, query: list[str]) -> Column:
    """(2 x terms among the tags + terms inside the content) per term, at most 1."""
    if not query:
        return F.lit(0.0)
    low, tags = F.lower(content), F.transform(tags, F.lower)
    hits = sum((F.when(F.array_contains(tags, t), 2).otherwise(0) + F.when(low.contains(t), 1).otherwise(0) for t in query), F.lit(0))
    return F.least(F.lit(1.0), hits / F.lit(float(len(query))))


def snippet(text: Column, size: int = 160) -> Column:
    """The text, or its beginning and three dots if it is longer than ``size``."""
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.left(text, F.lit(size - 3))), F.lit("..."))).otherwise(text)


def title(source: Column, content: Column) -> Column:
    """The source, else the first line (80 characters at most), else a placeholder."""
    line = F.trim(F.split(content, "\n")[0])
    line = F.when(F.length(line) > 80, F.concat(F.left(line, F.lit(77)), F.lit("..."))).otherwise(line)
    return F.coalesce(F.when(F.trim(source) != "", F.trim(source)), F.when(line != "", line), F.lit("Untitled memory"))


def chunk_starts(text: Column, size: int, overlap: int) -> Column:
    """Zero-based starts of windows of ``size`` characters; none for an empty text."""
    step = max(1, size - overlap)
    n = F.length(text)
    count = 1 + F.ceil(F.greatest(F.lit(0), n - size) / step)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<bigint>"))
