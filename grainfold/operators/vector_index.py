"""A stored index of vectors: matrix blocks by corpus, multiplied block by block.

A block holds up to BLOCK vectors of one corpus as one matrix, with their keys in order. Rows are dealt into ranges of
(corpus, key) first, so that a large corpus is many blocks in many tasks. Blocks lie in folders by a hash of the corpus; a
search reads the folders of asked corpora only. Queries become blocks too, and meet the blocks of their corpus by an
equi-join: each row of it is one matrix product, of which the k best of each query go on. Query blocks are broadcast while they
are small; beyond that, both sides are dealt by corpus and a salt, so that a large corpus stays in many tasks.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.postings import with_corpus
from grainfold.session import ship_package, stash

BLOCK, QUERY_BYTES, SALTS = 2048, 256 << 20, 32


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def place(k):
    """Any key's place in an order that nulls begin."""
    return tuple((v is not None, v) for v in k.values()) if isinstance(k, dict) else (k is not None, k)


def matrix_blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK, load=None) -> DataFrame:
    """corpus_id, keys, matrix, n: rows of up to `size` vectors of one corpus, their keys in order, one matrix row by row.
    A row without key or vector is left out. A batch of rows makes its own blocks. With load, an embedder's, `vector` is a column
    of texts (null: empty), whose vectors are made where their block is, one block at a time."""
    ship_package(df.sparkSession)

    def run(batches):
        encode = load() if load else None
        for batch in batches:
            corpora, keys, vectors = batch["corpus_id"].to_pylist(), batch["key"].to_pylist(), batch["vector"]
            wide = None if encode else pc.list_value_length(vectors).to_numpy()
            order = sorted(range(len(keys)), key=lambda i: (place(corpora[i]), place(keys[i])))
            for _, same in groupby(order, key=lambda i: place(corpora[i])):
                same = list(same)
                for part in (same[i : i + size] for i in range(0, len(same), size)):
                    own = vectors.take(pa.array(part, pa.int64()))
                    if encode:
                        flat = np.ascontiguousarray(encode(own.to_pylist()), np.float64).tobytes()
                    else:
                        if len(several := np.unique(wide[part])) > 1:
                            raise ValueError(f"vectors of several dimensions: {several.tolist()}")
                        flat = own.flatten().to_numpy(zero_copy_only=False).tobytes()
                    taken = batch["key"].take(pa.array(part, pa.int64()))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), taken)
                    yield pa.RecordBatch.from_arrays([batch["corpus_id"].take(pa.array(part[:1])), lists, pa.array([flat], pa.binary()), pa.array([len(part)], pa.int32())], ["corpus_id", "keys", "matrix", "n"])

    value = F.coalesce(F.col(vector), F.lit("")) if load else F.col(vector).cast("array<double>")
    rows = with_corpus(df).select("corpus_id", F.col(key).alias("key"), value.alias("vector")).dropna(subset=["key", "vector"])
    if "corpus_id" in df.columns:
        rows = rows.repartitionByRange("corpus_id", "key").sortWithinPartitions("corpus_id", "key")
    return rows.mapInArrow(run, f"corpus_id {kind_of(rows, 'corpus_id')}, keys array<{kind_of(rows, 'key')}>, matrix binary, n int")


def products(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score (six places): of each query block and block of one corpus the k best of each query."""
    kinds = [kind_of(df, "keys").removeprefix("array<").removesuffix(">") for df in (queries, blocks)]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asked, keys = batch["asked"][row].values, batch["keys"][row].values
                a = np.frombuffer(batch["queries"][row].as_py()).reshape(len(asked), -1)
                b = np.frombuffer(batch["matrix"][row].as_py()).reshape(len(keys), -1)
                scores = np.round(a @ b.T, 6)
                whose, which = [], []
                few = min(k, len(keys))
                least = np.partition(scores, len(keys) - few, axis=1)[:, len(keys) - few]
                for i, line in enumerate(scores):
                    found = np.flatnonzero(line >= least[i])
                    found = found[np.argsort(-line[found], kind="stable")][:few]
                    whose.append(np.full(len(found), i))
                    which.append(found)
                whose, which = np.concatenate(whose), np.concatenate(which)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(whose)), keys.take(pa.array(which)), pa.array(scores[whose, which] + 0.0)], ["query_id", "doc_id", "score"])

    q = queries.select("corpus_id", F.col("keys").alias("asked"), F.col("matrix").alias("queries"))
    if (q.agg(F.sum(F.octet_length("queries"))).first()[0] or 0) <= QUERY_BYTES:
        pairs = blocks.join(F.broadcast(q), "corpus_id")
    else:
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = blocks.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)).cast("int")).join(q, ["corpus_id", "salt"])
    return pairs.select("asked", "queries", "keys", "matrix").mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


class VectorIndex:
    """Blocks at path. What is added later is further files; len() and the rows are those of all additions."""

    def __init__(self, spark: SparkSession, path: str, schema=None):
        self.spark, self.path = spark, path
        self.blocks = (spark.read.schema(schema) if schema else spark.read).parquet(path)

    @staticmethod
    def folder(corpus, folders: int):
        return F.pmod(F.hash(corpus), F.lit(folders)).cast("int")

    @classmethod
    def add(cls, vectors: DataFrame, path: str, folders: int = 32) -> VectorIndex:
        """vectors: [corpus_id], doc_id, embedding. folders: the same at every addition."""
        made = matrix_blocks(vectors, "doc_id", "embedding").withColumn("folder", cls.folder(F.col("corpus_id"), folders)).withColumn("folders", F.lit(folders))
        made.write.mode("append").partitionBy("folder").parquet(path)
        return cls(vectors.sparkSession, path, made.schema)

    def size(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def of(self, corpora: DataFrame) -> DataFrame:
        """The blocks in the folders of these corpora (corpus_id)."""
        folders = self.blocks.agg(F.max("folders")).first()[0] or 1
        wanted = [r[0] for r in corpora.select(self.folder(F.col("corpus_id"), folders)).distinct().collect()]  # `folders` numbers at most
        return self.blocks.where(F.col("folder").isin(wanted))

    def scores(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: [corpus_id], query_id, query."""
        asked = stash(matrix_blocks(queries, "query_id", "query"), "query_blocks")
        return products(asked, self.of(asked), k)

    def vectors(self, ids: DataFrame | None = None) -> DataFrame:
        """corpus_id, doc_id, embedding as they were added; of `ids` ([corpus_id], doc_id) only, if given."""
        key, corpus = kind_of(self.blocks, "keys").removeprefix("array<").removesuffix(">"), kind_of(self.blocks, "corpus_id")

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    keys = batch["keys"][row].values
                    flat = pa.array(np.frombuffer(batch["matrix"][row].as_py()))
                    wide = len(flat) // len(keys)
                    lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, wide) if wide else [0] * (len(keys) + 1), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([batch["corpus_id"][row].as_py()] * len(keys), batch["corpus_id"].type), keys, lists], ["corpus_id", "doc_id", "embedding"])

        blocks = self.blocks if ids is None or "corpus_id" not in ids.columns else self.of(ids)
        rows = blocks.select("corpus_id", "keys", "matrix").mapInArrow(run, f"corpus_id {corpus}, doc_id {key}, embedding array<double>")
        return rows if ids is None else rows.join(ids.distinct(), [c for c in ids.columns if c in ("corpus_id", "doc_id")], "left_semi")
