"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a few runs, each a table bucketed and sorted by digest with one file a bucket: one row for each distinct
normalised text, with the document that stays. New data comes in batches: each is reduced to one row for each digest
(partial aggregation runs before the shuffle, so a text that fills a third of the rows is one row a task), anti-joined with
one run after the other, bucket by bucket, and what is new is appended as a run of its own. The runs are neither shuffled nor
sorted for that: the scan's own order is used. More than RUNS runs are merged into one. A batch that is admitted again, after
a crash say, finds its own digests and appends nothing; documents that stayed still stay.

Digests are written once, so that texts are read and hashed once however many batches there are.

Defined cases: a null text counts as empty; an empty or very long text is a text like any other; rows that repeat a
doc_id with the same text are one document seen twice: each counts in group_size and all carry kept = true if that
doc_id stays; a null doc_id sorts after every other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import delete, documents, join_counted, partitions, shared_dir, stash

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ").cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), digest(docs[text_col]).alias("digest"))


#: Runs of an index before they are merged; Spark's setting by which a scan of one file a bucket is known to be sorted.
RUNS, ORDERED = 8, "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestIndex:
    """A persistent index: tables in the catalog, named by generation and run, their files in the cluster's shared folder.

    A merge makes the first run of the next generation; older generations count no more, and are dropped then or, after a
    crash, by the next merge.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.path = f"{shared_dir(spark)}/{name}"
        self.buckets = buckets or partitions(spark)
        spark.conf.set(ORDERED, "true")

    def tables(self) -> list[tuple[int, int]]:
        """(generation, run) of all tables, in order."""
        found = [t.name.rsplit("_", 2)[1:] for t in self.spark.catalog.listTables(pattern=f"{self.name}_*")]
        return sorted((int(g), int(r)) for g, r in found)

    def runs(self) -> list[tuple[int, int]]:
        every = self.tables()
        return [t for t in every if t[0] == every[-1][0]]

    def run(self, at: tuple[int, int]) -> DataFrame:
        return self.spark.table(f"{self.name}_{at[0]}_{at[1]}")

    def write(self, rows: DataFrame, at: tuple[int, int]) -> None:
        (
            rows.repartition(self.buckets, "digest").write.format("parquet").option("path", f"{self.path}/g{at[0]}/{uuid.uuid4().hex}")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(f"{self.name}_{at[0]}_{at[1]}")
        )

    def append(self, rows: DataFrame) -> None:
        """rows: digests that no run has."""
        last = (self.runs() or [(0, -1)])[-1]
        self.write(rows, (last[0], last[1] + 1))
        if last[1] + 2 > RUNS:
            self.write(self.rows(), (last[0] + 1, 0))
            for old in [t for t in self.tables() if t[0] <= last[0]]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{old[0]}_{old[1]}")
                delete(self.spark, f"{self.path}/g{old[0]}")

    def rows(self) -> DataFrame:
        out = self.spark.createDataFrame([], "digest binary, keep_id bigint")
        for at in self.runs():
            out = out.unionByName(self.run(at))
        return out

    def admit(self, seen: DataFrame) -> None:
        """Append the digests of seen (doc_id, digest) that the index lacks, each with its smallest doc_id."""
        new = seen.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        for at in self.runs():
            new = new.join(self.run(at).select("digest").hint("merge"), "digest", "left_anti")
        self.append(new)

    def found(self, digests: DataFrame) -> DataFrame:
        """digests (digest, ...) that the index has, with keep_id."""
        names = []
        for i, at in enumerate(self.runs()):
            names.append(f"__keep_{i}")
            known = self.run(at).select("digest", F.col("keep_id").alias(names[-1]), F.lit(True).alias(f"{names[-1]}_there"))
            digests = digests.join(known.hint("merge"), "digest", "left")
        if not names:
            return digests.withColumn("keep_id", F.lit(None).cast("bigint")).where("false")
        there = [F.col(f"{n}_there") for n in names]
        return digests.where(F.coalesce(*there)).withColumn("keep_id", F.coalesce(*names)).drop(*names, *[f"{n}_there" for n in names])

    def drop(self) -> None:
        for at in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{at[0]}_{at[1]}")
        delete(self.spark, self.path)


def batches_by_id(seen: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in `batches` parts of about one size, smaller doc_ids first and null ones last."""
    shares = [(i + 1) / batches for i in range(batches - 1)]
    edges = (seen.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None) or []
    edges = sorted(set(edges))
    low = [F.lit(True), *[F.col("doc_id") > e for e in edges]]
    high = [*[F.col("doc_id") <= e for e in edges], F.lit(True)]
    parts = [seen.where(a & b) for a, b in zip(low[:-1], high[:-1], strict=True)]
    return [*parts, seen.where(low[-1] | F.col("doc_id").isNull())]


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; docs are admitted to the index in `batches` batches.

    A text that the index had before keeps the earlier document, whatever its id; among docs the smallest doc_id stays.
    group_size counts the rows of docs with the text.
    """
    seen = stash(digests(docs, id_col, text_col), "digests")
    for batch in batches_by_id(seen, batches):
        index.admit(batch)
    sizes = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stash(index.found(sizes), "groups")
    return join_counted(seen, groups, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def once(docs: DataFrame, batches: int) -> DataFrame:
    """exact_dedup() with an index of its own, which is gone afterwards."""
    index = fresh_index(docs.sparkSession)
    try:
        return exact_dedup(docs, index, batches=batches)
    finally:
        index.drop()


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(documents(spark, sf_dir), batches=2)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
