"""Grounding scores, agreement with reference scores, and figures about example sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from grainfold.functions import text as T

METRICS = ("relevance", "utilization", "completeness")
#: Columns of reference scores in example sets.
REFERENCE = {"relevance": "relevance_score", "utilization": "utilization_score", "completeness": "completeness_score", "adherence": "adherence_score"}
GOLD = ("all_relevant_sentence_keys", "all_utilized_sentence_keys", "unsupported_response_sentence_keys")


def grounding(total: Column, relevant: Column, utilized: Column, unsupported: Column) -> list[Column]:
    """Relevance and utilization count list entries (repeats included); completeness compares sets with a list's length."""
    share = lambda keys: F.when(total == 0, F.lit(0.0)).otherwise(F.size(keys) / total)
    complete = F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(relevant, utilized)) / F.size(relevant))
    return [share(relevant).alias("relevance"), share(utilized).alias("utilization"), complete.alias("completeness"), (F.size(unsupported) == 0).alias("adherence")]


def gold_scores(examples: DataFrame) -> DataFrame:
    """Examples with the scores that follow from their own labels; documents_sentences holds the sentences of each document."""
    total = F.aggregate("documents_sentences", F.lit(0), lambda n, d: n + F.size(d))
    return examples.select("*", *grounding(total, *map(F.col, GOLD)))


def first_keys(keys: Column, fraction: float) -> Column:
    """A deterministic judge: the first part of all keys, one at least if there are any."""
    n = F.greatest(F.lit(1), F.floor(F.size(keys) * fraction).cast("int"))
    return F.when(F.size(keys) > 0, F.slice(keys, 1, n)).otherwise(keys)


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def agreement(rows: DataFrame, ours: str, theirs: str, *by: str) -> DataFrame:
    d = F.col(ours) - F.col(theirs)
    return rows.groupBy(*by).agg(
        F.count(ours).alias("n_scored"), F.round(zero(F.sqrt(F.avg(d * d))), 6).alias("rmse"),
        F.round(zero(F.avg(F.abs(d))), 6).alias("mae"), F.round(zero(F.avg(d)), 6).alias("signed"), F.round(F.max(F.abs(d)), 6).alias("max_gap"),
    )


def validation(rows: DataFrame, *by: str) -> DataFrame:
    """Own scores against {metric}_ref, with how many agree exactly; by example set, or by domain, or both."""
    out = [F.count(F.lit(1)).alias("n")]
    for m in METRICS:
        d = F.abs(F.col(m) - F.col(f"{m}_ref"))
        out += [F.round(zero(F.sqrt(F.avg(d * d))), 6).alias(f"{m}_rmse"), F.round(zero(F.max(d)), 6).alias(f"{m}_max_gap"), F.count_if(d < 1e-9).alias(f"{m}_exact")]
    same = F.col("adherence") == F.col("adherence_ref")
    return rows.groupBy(*by).agg(*out, F.count_if(same).alias("adherence_correct"), F.round(zero(F.avg(F.coalesce(same, F.lit(False)).cast("int"))), 6).alias("adherence_accuracy"))


def reference_means(examples: DataFrame, *by: str) -> DataFrame:
    """Mean reference scores, true counting as 1; null where there are none."""
    return examples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.expr(f"try_cast({c} AS double)")).alias(m) for m, c in REFERENCE.items()])


def gap_summary(rows: DataFrame) -> DataFrame:
    """rows: {metric}_gap columns. Bias is the mean gap, spread its population deviation; metrics without a gap are left out."""
    names = [c for c in rows.columns if c.endswith("_gap")]
    long = rows.unpivot([], names, "metric", "gap").where("gap IS NOT NULL").withColumn("metric", F.regexp_replace("metric", "_gap$", ""))
    return long.groupBy("metric").agg(
        F.count("gap").alias("n_cells"), F.round(F.avg("gap"), 6).alias("bias"), F.round(F.stddev_pop("gap"), 6).alias("spread"), F.round(F.min("gap"), 6).alias("gap_min"), F.round(F.max("gap"), 6).alias("gap_max"),
    )


def gap_table(compared: DataFrame, *key: str) -> DataFrame:
    """A row for each key and metric: ours and the reference to three places, the gap with its sign, empty if there is none."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("ours"), F.col(f"{m}_ref").cast("double").alias("reference"), F.col(f"{m}_gap").cast("double").alias("gap")) for m in (*METRICS, "adherence")]))
    signed = F.when(F.col("c.gap").isNull(), "").otherwise(F.format_string("%+.3f", "c.gap"))
    return compared.select(*key, cells.alias("c")).select(*key, "c.metric", F.round("c.ours", 3).alias("ours"), F.round("c.reference", 3).alias("reference"), signed.alias("gap"))


def plot_rows(rows: DataFrame, *key: str) -> DataFrame:
    """What bar charts of a matrix or a comparison are drawn from: key, metric, series (ours or reference), value."""
    series = {"ours": "", "reference": "_ref"}
    bars = [F.struct(F.lit(m).alias("metric"), F.lit(s).alias("series"), F.col(m + x).cast("double").alias("value")) for m in (*METRICS, "adherence") for s, x in series.items() if m + x in rows.columns]
    return rows.select(*key, F.explode(F.array(*bars)).alias("b")).select(*key, "b.*").where("value IS NOT NULL")


# Example sets


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round(p * (n - 1)) of the sorted array, halves to the even place; null of nothing."""
    return T.let(F.sort_array(values), lambda v: F.get(v, F.least(F.size(v) - 1, F.bround(F.lit(p) * (F.size(v) - 1)).cast("int"))))


def ranked_value(counts: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """nearest_rank() within groups, from (by, value, n) rows of how often each value occurs, so that no group is collected."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    placed = counts.withColumn("__upto", F.sum("n").over(so_far)).join(total, by)
    return placed.where(F.col("__upto") > F.bround(F.lit(p) * (F.col("__total") - 1))).groupBy(*by).agg(F.min(value).alias(name))


def document_statistics(examples: DataFrame, *by: str) -> DataFrame:
    """examples (by, documents): documents an example, words a document, and how much chunking can matter there."""
    by = list(by)
    size = examples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(F.size("documents")).alias("docs_median"), F.max(F.size("documents")).alias("docs_max"))
    words = examples.select(*by, F.explode("documents").alias("d")).select(*by, F.coalesce(F.size(T.words(F.col("d"))), F.lit(0)).alias("words"))
    counts = words.groupBy(*by, "words").agg(F.count(F.lit(1)).alias("n"))
    tables = [ranked_value(counts, by, "words", p, name) for p, name in ((0.5, "words_median"), (0.95, "words_p95"))]
    tables.append(counts.groupBy(*by).agg(F.max("words").alias("words_max")))
    out = reduce(lambda a, b: a.join(b, by, "left"), tables, size)
    lever = F.when(F.col("words_median").isNull(), "?").when(F.col("words_p95") > 800, "HIGH").when((F.col("words_median") < 200) & (F.col("docs_median") >= 3), "LOW").otherwise("MEDIUM")
    return out.withColumn("chunking_lever", lever)


def field_presence(examples: DataFrame, fields: list[str]) -> DataFrame:
    """For each candidate and each actual field: whether it was expected, is there, and how many rows have a value."""
    actual = {f.name: f.dataType.simpleString() for f in examples.schema}
    names = [*fields, *sorted(set(actual) - set(fields))]
    counted = examples.agg(*[(F.count(F.col(f"`{n}`")) if n in actual else F.lit(0).cast("bigint")).alias(f"c{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("field"), F.lit(n in fields).alias("expected"), F.lit(n in actual).alias("present"), F.lit(actual.get(n)).alias("type"), F.col(f"c{i}").alias("n_values")) for i, n in enumerate(names)]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_dump(examples: DataFrame, prefix: str = "") -> DataFrame:
    """A row for each field, those of structures and of arrays' elements too (path), with its type and whether all rows have it."""
    def fields(kind: t.DataType, path: str):
        if isinstance(kind, t.StructType):
            for f in kind:
                inner = f"{path}.{f.name}" if path else f.name
                yield inner, f.dataType.simpleString(), f.nullable
                yield from fields(f.dataType, inner)
        elif isinstance(kind, t.ArrayType):
            yield from fields(kind.elementType, f"{path}[]")

    rows = [(i, *f) for i, f in enumerate(fields(examples.schema, prefix))]
    return examples.sparkSession.createDataFrame(rows, "place int, path string, type string, nullable boolean")


def score_ranges(examples: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """Count, least, largest and mean value of each numeric score."""
    numeric = [f for f in fields if f in examples.columns and isinstance(examples.schema[f].dataType, t.NumericType)]
    long = examples.select(*by, *[F.col(f).cast("double").alias(f) for f in numeric]).unpivot(list(by), numeric, "field", "value").where("value IS NOT NULL")
    return long.groupBy(*by, "field").agg(F.count("value").alias("n"), F.round(F.min("value"), 3).alias("low"), F.round(F.max("value"), 3).alias("high"), F.round(F.avg("value"), 3).alias("mean"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b does not have, as many times as a has more of them."""
    return a.exceptAll(b)


def split_sizes(examples: DataFrame, splits: list[str], *by: str) -> DataFrame:
    """Rows of each split, a column a split."""
    return examples.groupBy(*by).pivot("split", splits).agg(F.count(F.lit(1)))
