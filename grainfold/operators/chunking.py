"""Documents to chunks (doc_id, chunk_no, chunk_id, text). Empty and blank documents have none; numbers start at 0 in each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from grainfold.functions import text as T
from grainfold.functions import vectors as V
from grainfold.functions.text import checked_window
from grainfold.operators.embedding import Embedder, named
from grainfold.operators.registry import OPERATORS, register
from grainfold.operators.tables_in_sql import starts, windows
from grainfold.session import ship_package

Chunker = Callable[[DataFrame], DataFrame]
PIECES = 4 << 20


def numbered_pieces(docs: DataFrame, pieces: Column) -> DataFrame:
    made = docs.select("doc_id", F.posexplode(pieces).alias("chunk_no", "text"))
    return made.select("doc_id", "chunk_no", F.concat_ws("-", F.col("doc_id").cast("string"), "chunk_no").alias("chunk_id"), "text")


def by_column(windows: Callable[..., Column], **options) -> Chunker:
    windows(F.lit(""), **options)  # parameters are checked when the chunker is made
    return lambda docs: numbered_pieces(docs, windows(F.col("text"), **options))


def in_worker(windows: Callable[[str], Iterator[str]]) -> Chunker:
    """The pieces of a text by a function of it, where Python is faster than columns: its split() and strip() know the same blanks.
    Pieces leave the worker PIECES characters at a time."""

    def run(batches):
        for batch in batches:
            whose, numbers, pieces, chars = [], [], [], 0
            for i, text in enumerate(batch["text"]):
                for k, piece in enumerate(windows(text.as_py() or "")):
                    whose.append(i)
                    numbers.append(k)
                    pieces.append(piece)
                    chars += len(piece)
                    if chars >= PIECES:
                        yield rows(batch, whose, numbers, pieces)
                        whose, numbers, pieces, chars = [], [], [], 0
            yield rows(batch, whose, numbers, pieces)

    def rows(batch, whose, numbers, pieces):
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(whose, pa.int64())), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], ["doc_id", "chunk_no", "text"])

    def chunker(docs: DataFrame) -> DataFrame:
        ship_package(docs.sparkSession)
        texts = docs.select("doc_id", F.make_valid_utf8("text").alias("text"))
        made = texts.mapInArrow(run, StructType([texts.schema["doc_id"], StructField("chunk_no", IntegerType()), StructField("text", StringType())]))
        return made.select("doc_id", "chunk_no", F.concat_ws("-", F.col("doc_id").cast("string"), "chunk_no").alias("chunk_id"), "text")

    return chunker


def word_windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """T.fixed_windows() in the worker."""
    return windows(text.split(), size, overlap, " ")


def headed_windows(text: str, size: int, overlap: int, summary: int) -> Iterator[str]:
    """T.summary_windows() in the worker."""
    text = text.strip()
    head = text[:summary].replace("\n", " ").strip()
    prefix = f"{head}\n\n" if head else ""
    return (prefix + text[a : a + size] for a in starts(len(text), size, overlap))


@register("chunker", "fixed")
def fixed(size: int = 512, overlap: int = 50) -> Chunker:
    checked_window(size, overlap)
    return in_worker(partial(word_windows, size=size, overlap=overlap))


@register("chunker", "paragraphs", "pgc")
def paragraphs(paragraphs: int = 2, overlap: int = 1) -> Chunker:
    return by_column(T.paragraph_groups, size=paragraphs, overlap=overlap)


@register("chunker", "summary", "sac")
def summary(size: int = 500, overlap: int = 0, summary_chars: int = 150) -> Chunker:
    checked_window(size, overlap)
    if summary_chars < 0:
        raise ValueError("summary_chars >= 0 is needed")
    return in_worker(partial(headed_windows, size=size, overlap=overlap, summary=summary_chars))


@register("chunker", "none")
def none() -> Chunker:
    return by_column(lambda c: F.when(T.strip(c) != "", F.array(c)).otherwise(F.array().cast("array<string>")))


def cuts(similarities: Column, breakpoint: str, percentile: float, threshold: float) -> Column:
    """Whether to cut behind each sentence but the last: where neighbours are farther apart than the percentile of all
    distances, or less similar than the threshold."""
    if breakpoint == "absolute":
        return F.transform(similarities, lambda s: s < threshold)
    distances = F.transform(similarities, lambda s: 1 - s)
    return T.let(distances, lambda d: T.let(V.percentile(d, percentile), lambda limit: F.transform(d, lambda x: x > limit)))


@register("chunker", "semantic")
def semantic(model: str | None = None, breakpoint: str = "percentile", percentile: float = 95.0, threshold: float = 0.5, embedder: Embedder | None = None) -> Chunker:
    """Runs of sentences, cut where the meaning of neighbours shifts. Similarities are rounded to nine places, so that
    equal ones stay equal whatever adds them up."""
    if breakpoint not in ("percentile", "absolute"):
        raise ValueError("breakpoint is 'percentile' or 'absolute'")
    if not 0 < percentile < 100 or not 0 <= threshold <= 1:
        raise ValueError("0 < percentile < 100 and 0 <= threshold <= 1 are needed")
    model = embedder or named(model)

    def chunk(docs: DataFrame) -> DataFrame:
        split = docs.select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
        seen = split.withColumn("v", model.neighbours(F.col("s")))
        near = F.transform("v", lambda x: F.round(x, 9))
        cut = seen.select("doc_id", "s", F.when(F.size("s") > 1, cuts(near, breakpoint, percentile, threshold)).otherwise(F.array().cast("array<boolean>")).alias("cut"))
        ends = F.concat(F.filter(F.transform("cut", lambda c, i: F.when(c, i + 1)), lambda e: e.isNotNull()), F.array(F.size("s")))
        pieces = T.let(ends, lambda e: F.transform(e, lambda end, k: T.let(F.when(k > 0, e[k - 1]).otherwise(0), lambda start: F.array_join(F.slice(F.col("s"), start + 1, end - start), " "))))
        return numbered_pieces(cut, pieces)

    return chunk


def chunk(docs: DataFrame, kind: str = "fixed", **options) -> DataFrame:
    return OPERATORS.build("chunker", kind, **options)(docs)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Each text once, with its first document."""
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


