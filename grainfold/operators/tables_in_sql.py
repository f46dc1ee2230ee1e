"""Chunkers as table functions, for texts of SQL: `SELECT * FROM fixed_chunks(TABLE(documents) PARTITION BY (doc_id), 128, 16)`.

A table function gets its rows one after the other and holds the words of one document at a time. The chunkers of
`chunking` do the same batch by batch or inside the JVM and are the way for large tables; these are for people who write SQL. Names are those
of the session in which register_table_functions() was called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from grainfold.functions.text import BLANK, checked_window
from grainfold.session import ship_package

CHUNKS = "doc_id bigint, chunk_no int, chunk_id string, text string"


def starts(n: int, size: int, overlap: int) -> range:
    """Where windows over n parts begin, up to the first that reaches the end; none for nothing."""
    step = checked_window(size, overlap)
    return range(0, max(1, n - size + step) if n else 0, step)


def windows(parts: list[str], size: int, overlap: int, glue: str) -> Iterator[str]:
    for start in starts(len(parts), size, overlap):
        yield glue.join(parts[start : start + size])


def numbered(doc_id: int, pieces: Iterator[str]) -> Iterator[tuple]:
    for i, piece in enumerate(pieces):
        yield doc_id, i, f"{doc_id}-{i}", piece


class FixedChunks:
    """Windows of `size` words that share `overlap` words with the next one; rows need doc_id and text, and may have more."""

    def eval(self, row: Row, size: int, overlap: int):
        words = [w for w in re.split(f"{BLANK}+", row["text"] or "") if w]
        yield from numbered(row["doc_id"], windows(words, size, overlap, " "))


class ParagraphChunks:
    """Windows of `size` paragraphs: parts between blank lines, or between lines if that gives one part only."""

    def eval(self, row: Row, size: int, overlap: int):
        def parts(pattern: str) -> list[str]:
            return [p for p in (trimmed(x) for x in re.split(pattern, row["text"] or "")) if p]

        found = parts(rf"\n{BLANK}*\n")
        yield from numbered(row["doc_id"], windows(found if len(found) > 1 else parts("\n"), size, overlap, "\n\n"))


def trimmed(text: str) -> str:
    """Without blanks at both ends, each looked at once."""
    blank, a, b = re.compile(BLANK).match, 0, len(text)
    while a < b and blank(text[a]):
        a += 1
    while b > a and blank(text[b - 1]):
        b -= 1
    return text[a:b]


FUNCTIONS = {"fixed_chunks": FixedChunks, "paragraph_chunks": ParagraphChunks}


def register_table_functions(spark: SparkSession) -> None:
    ship_package(spark)
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=CHUNKS))
