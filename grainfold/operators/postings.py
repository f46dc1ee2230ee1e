"""A stored inverted index: postings by term in buckets, cut into blocks that BM25 can leave out.

Documents are dealt into slices by a hash. A block holds the postings of one term in one slice, each with its share of the
score (all but the weight of the term), its largest shares first, and apart from them the TOPS largest. So no block grows with a
term, and blocks of all terms speak of the same documents slice by slice. A search reads the asked terms' buckets only.
From the blocks' tops alone it gets a score that k documents surely reach (the k-th largest share of one term, times its weight)
and the most that a slice can give (the sum of its blocks' largest shares, times their weights); postings of slices that
cannot reach the k best are not read.

docs: [corpus_id], doc_id, text; a query looks at documents of its corpus only. The index is made anew when documents come,
because every share depends on the mean length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.session import ship_package, sized, stash

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Places are rounded to six digits, so that much may be missing at a block's bound.
TOPS, SLACK, MOST_WEIGHTS, SALTS, FEW = 16, 1e-6, 2_000_000, 32, 64


def with_corpus(df: DataFrame) -> DataFrame:
    return df if "corpus_id" in df.columns else df.withColumn("corpus_id", F.lit(0))


def lower_words(c):
    return T.words(F.lower(F.coalesce(c, F.lit(""))))


def block_schema(keys: DataFrame) -> str:
    corpus, doc = (keys.schema[c].dataType.simpleString() for c in ("corpus_id", "doc_id"))
    return f"bucket int, corpus_id {corpus}, term string, slice int, n int, postings array<struct<share: double, doc_id: {doc}>>, tops array<double>"


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.docs, self.corpora = (spark.read.parquet(f"{path}/{name}") for name in ("docs", "corpora"))
        self.blocks = spark.read.schema(block_schema(self.docs)).parquet(f"{path}/blocks")
        self.single = self.corpora.limit(2).count() < 2
        self.buckets, self.slices = self.corpora.agg(F.max("buckets"), F.max("slices")).first()
        self.buckets, self.slices = self.buckets or 1, self.slices or 0

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = 32, slice_docs: int = 512) -> PostingsIndex:
        spark = docs.sparkSession
        texts = with_corpus(docs).select("corpus_id", "doc_id", lower_words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
        terms = texts.select("corpus_id", "doc_id", "size", F.explode(F.array_append("w", F.lit(None))).alias("term"))  # null: the document itself
        counts = stash(terms.groupBy("corpus_id", "doc_id", "size", "term").agg(F.count(F.lit(1)).alias("tf")), "term_counts")
        own = counts.where("term IS NULL").select("corpus_id", "doc_id", "size")
        own.write.parquet(f"{path}/docs")
        slices = max(1, -(-spark.read.parquet(f"{path}/docs").count() // slice_docs))
        df = stash(counts.groupBy("corpus_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("words")), "vocabulary")
        sizes = df.where("term IS NULL").select("corpus_id", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))
        idf = df.where("term IS NOT NULL").join(sizes.drop("avgdl"), "corpus_id").select("corpus_id", cls.plain_idf().alias("idf"))
        mean = idf.groupBy("corpus_id").agg(F.avg("idf").alias("mean_idf"))
        sizes.join(mean, "corpus_id", "left").withColumns({"buckets": F.lit(buckets), "slices": F.lit(slices)}).write.parquet(f"{path}/corpora")
        corpora = spark.read.parquet(f"{path}/corpora")
        few = F.broadcast(corpora) if corpora.limit(2).count() < 2 else corpora
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))
        rows = counts.where("term IS NOT NULL").join(few, "corpus_id").select(
            cls.bucket(F.col("term"), buckets).alias("bucket"), "corpus_id", "term",
            F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), share.alias("share"), "doc_id",
        ).withColumn("h", F.xxhash64("corpus_id", "term", "slice"))
        dealt = rows.repartition("bucket", F.col("slice") % SALTS)  # a hot term is in many tasks
        dealt.transform(cls.cut).write.partitionBy("bucket").parquet(f"{path}/blocks")
        return cls(spark, path)

    @staticmethod
    def cut(rows: DataFrame) -> DataFrame:
        """Blocks of rows that belong together; one that two Arrow batches share is two blocks."""
        ship_package(rows.sparkSession)

        def run(batches):
            for batch in batches:
                new = np.zeros(batch.num_rows, bool)
                new[:1] = True
                for c in ("h", "term", "slice"):
                    new[1:] |= pc.not_equal(batch[c].slice(1), batch[c].slice(0, max(0, batch.num_rows - 1))).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(new)
                ends = np.append(at, batch.num_rows).astype(np.int32)
                posts = pa.StructArray.from_arrays([batch["share"], batch["doc_id"]], ["share", "doc_id"])
                few = np.minimum(np.diff(ends), TOPS)
                tops = np.repeat(at - np.concatenate(([0], np.cumsum(few)[:-1])), few) + np.arange(few.sum()) if len(at) else at
                lists = {
                    "n": pa.array(np.diff(ends)), "postings": pa.ListArray.from_arrays(pa.array(ends), posts),
                    "tops": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(few))).astype(np.int32)), batch["share"].take(pa.array(tops, pa.int64()))),
                }
                yield pa.RecordBatch.from_pydict({c: batch[c].take(pa.array(at)) for c in ("bucket", "corpus_id", "term", "slice")} | lists)

        ordered = rows.sortWithinPartitions("bucket", "h", "term", "slice", F.desc("share"), "doc_id")
        return ordered.mapInArrow(run, block_schema(rows))

    @staticmethod
    def plain_idf():
        return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    @staticmethod
    def bucket(term, buckets: int):
        return F.pmod(F.hash(term), F.lit(buckets)).cast("int")

    def asked_blocks(self, asked: DataFrame) -> DataFrame:
        """Blocks of the buckets in which asked terms are: whole folders of the table are left out."""
        wanted = [r[0] for r in asked.select(self.bucket(F.col("term"), self.buckets)).distinct().collect()]  # numbers of buckets
        return self.blocks.where(F.col("bucket").isin(wanted))

    def weights(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """corpus_id, query_id, term, weight; a negative idf is replaced by a share of the mean."""
        few = F.broadcast(self.corpora) if self.single else self.corpora
        terms = sized(asked.select("corpus_id", "term").distinct(), MOST_WEIGHTS)
        met = blocks.select("corpus_id", "term", "n").join(terms, ["corpus_id", "term"], "left_semi").groupBy("corpus_id", "term").agg(F.sum("n").alias("df"))
        idf = met.join(few, "corpus_id").withColumn("idf", self.plain_idf())
        floor = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
        return asked.join(idf.select("corpus_id", "term", floor.alias("idf")), ["corpus_id", "term"]).select("corpus_id", "query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"))

    @staticmethod
    def live(met: DataFrame, k: int) -> DataFrame:
        """query_id, slice: where the k best may be. met: query_id, term, slice, weight, tops."""
        best = F.greatest(F.col("weight") * F.col("tops")[0], F.lit(0.0))
        most = met.groupBy("query_id", "slice").agg(F.sum(best).alias("most"), F.min("weight").alias("least"))
        reached = met.select("query_id", "term", F.explode(F.transform("tops", lambda s: s * F.col("weight"))).alias("got"))
        place = F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("got")))
        sure = reached.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).groupBy("query_id").agg(F.max("got").alias("sure"))
        signs = most.groupBy("query_id").agg(F.min("least").alias("sign"))  # with a negative weight nothing is sure
        return most.join(sure.join(signs, "query_id").where("sign >= 0"), "query_id", "left").where(F.col("sure").isNull() | (F.col("most") >= F.col("sure") - SLACK)).select("query_id", "slice")

    def scores(self, queries: DataFrame, k: int) -> DataFrame:
        """corpus_id, query_id, doc_id, score of all documents that can be among the k best, and the first k documents of each
        corpus, which have the places that matches leave over."""
        queries = with_corpus(queries).select("corpus_id", "query_id", "query")
        asked = queries.select("corpus_id", "query_id", F.explode(lower_words(F.col("query"))).alias("term"))
        asked = asked.groupBy("corpus_id", "query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        blocks = self.asked_blocks(asked)
        weights = stash(self.weights(asked, blocks), "weights")
        if weights.count() <= MOST_WEIGHTS:
            pairs = lambda side: side.join(F.broadcast(weights), ["corpus_id", "term"])
        else:  # a term's blocks go to several tasks
            dealt = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = lambda side: side.withColumn("salt", F.pmod("slice", F.lit(SALTS))).join(dealt, ["corpus_id", "term", "salt"])
        met = pairs(blocks.select("corpus_id", "term", "slice", "postings"))
        if self.slices > FEW:  # to ask which slices can be left out costs more than to read as few as that
            tops = pairs(blocks.select("corpus_id", "term", "slice", F.slice("tops", 1, k).alias("tops")))
            met = met.join(self.live(tops.select("query_id", "term", "slice", "weight", "tops"), k), ["query_id", "slice"])
        parts = met.select("corpus_id", "query_id", "weight", F.explode("postings").alias("p")).select("corpus_id", "query_id", F.col("p.doc_id").alias("doc_id"), (F.col("weight") * F.col("p.share")).alias("part"))
        place = F.row_number().over(Window.partitionBy("corpus_id").orderBy("doc_id"))
        first = self.docs.select("corpus_id", "doc_id").withColumn("place", place).where(F.col("place") <= k).drop("place")
        rest = queries.select("corpus_id", "query_id").join(first, "corpus_id").select("corpus_id", "query_id", "doc_id", F.lit(0.0).alias("part"))
        return parts.unionByName(rest).groupBy("corpus_id", "query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
