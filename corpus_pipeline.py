"""From raw documents to packed sequences: classify, deduplicate exactly, nearly and by passage, then pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before
it kept. run() writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import exact_dedup, jaccard_join, packing, quality_classifier, span_dedup
from grainfold.llm.common import documents, ship_package, stash


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject, as the rows they are.

    Defined cases: a null text counts as empty, and null metadata as such; equal rows have equal scores, so all of them stay
    or none; without labels all documents stay; an
    empty table gives no rows; all columns pass through, whatever their names.
    """
    ship_package(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row of the document with the smallest doc_id (null last); which one, if rows repeat it, is left open.

    Defined cases: null and empty texts are equal to each other, and one row of them stays; runs of white space count as one
    space; an empty table gives no rows; all columns pass through, whatever their names.
    """
    keep, digest, own = (fresh(docs, n) for n in ("__keep", "__digest", "__own"))
    found = exact_dedup.once(docs, batches=2).where("kept").select(F.col("keep_id").alias(keep), F.unhex("text_sha256").alias(digest)).distinct()
    same = F.expr(f"doc_id <=> `{keep}` AND `{own}` = `{digest}`")
    return docs.withColumn(own, exact_dedup.digest(docs["text"])).join(found.hint("merge"), same, "left_semi").dropDuplicates([own]).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the smallest doc_id (null last); equal rows are one row.

    A row is known by a hash of its doc_id and text, because rows may share a doc_id.
    Defined cases: texts without words, null ones too, are near nothing, and all stay; ties go to the row with the smallest
    hash; an empty table gives no rows; all columns pass through, whatever their names.
    """
    own = fresh(docs, "__row")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = jaccard_join.jaccard_components(keyed, id_col=own).select(F.col("doc_id").alias(own), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col(own).alias("row"))
    first = keyed.select(own, "doc_id").join(found.hint("merge"), own).groupBy("component_id").agg(F.min(place).alias("at"))
    return keyed.join(first.select(F.col("at.row").alias(own)).hint("merge"), own, "left_semi").select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller doc_id has.

    Defined cases: a null text becomes empty; a text that is all passage becomes empty and stays a row; bytes that are left of a
    cut character go; rows that repeat a doc_id do not cut each other; n_chars, if there, is counted anew; an empty table
    gives no rows.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = span_dedup.span_dedup(docs, with_text=True, carry=others).withColumn("text", F.col("kept_text"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    Defined cases: a null or empty text is its end token alone; pieces of equal length may trade places; rows that repeat are
    packed one by one; an empty table gives no rows; other columns are not read.
    """
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
