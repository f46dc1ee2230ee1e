"""Reading example sets and result matrices, and writing matrices, traces and comparisons."""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from grainfold.session import sized, stash

#: Splits that may be read, example sets by domain, and the columns of a result matrix and of a judge's report.
SPLITS = ("train", "validation", "test")
DOMAINS = {
    "Biomedical": ["pubmedqa", "covidqa"],
    "GenKnowledge": ["hotpotqa", "msmarco", "hagrid", "expertqa"],
    "Legal": ["cuad"],
    "CustomerSupport": ["techqa", "emanual", "delucionqa"],
    "Finance": ["finqa", "tatqa"],
}
STAGES = ["chunker", "embedder", "index", "retriever", "reranker", "repacker", "summarizer", "prompt", "generator"]
SCORES = ["relevance", "utilization", "completeness", "adherence"]
MATRIX = t.StructType(
    [t.StructField(c, t.StringType()) for c in ["config_name", "config_id", "domain", *STAGES]]
    + [t.StructField(c, t.LongType()) for c in ("n", "n_scored")]
    + [t.StructField(c, t.DoubleType()) for c in SCORES]
    + [t.StructField("scoring", t.StringType())]
)


REPORT = [
    "model", "prompt_variant", "domain", "config", "n", "n_scored", "n_failed",
    "relevance_rmse", "relevance_mae", "relevance_signed",
    "utilization_rmse", "utilization_mae", "utilization_signed",
    "completeness_rmse", "completeness_mae", "completeness_signed",
    "adherence_acc", "adherence_over_flag", "adherence_under_flag",
]


def running_totals(df: DataFrame, value: str, total: str, *key: str, by: str | None = None, by_total: str | None = None) -> DataFrame:
    """df with the sum of value over all rows up to this one by key, and over those of its own `by`.

    Rows are dealt into ranges of the key; each range adds the sums of the ranges before it, a number for each range
    (and `by`; these are broadcast up to a million).
    """
    dealt = stash(df.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "running")
    sums = dealt.groupBy("__part", *([by] if by else [])).agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    every = sums.groupBy("__part").agg(F.sum("__sum").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__before"))  # one row a partition
    within = Window.partitionBy("__part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(every), "__part").withColumn(total, F.col("__before") + F.sum(value).over(within))
    if by:
        parts = every.select("__part").join(sums.select(by).distinct())  # partitions x legs
        grid = parts.join(sums, ["__part", by], "left").fillna(0.0, "__sum")
        earlier = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        own = grid.select("__part", by, F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__own"))
        mine = Window.partitionBy("__part", by).orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        out = out.join(sized(own, 1_000_000), ["__part", by]).withColumn(by_total, F.col("__own") + F.sum(value).over(mine))
    return out.drop("__part", "__before", "__own")


def configs_for(domain: str, domains: dict[str, list[str]] = DOMAINS) -> list[str]:
    if domain not in domains:
        raise ValueError(f"unknown domain {domain!r}, one of {sorted(domains)} is needed")
    return domains[domain]


def domain_of(config: str, domains: dict[str, list[str]] = DOMAINS) -> str | None:
    return next((d for d, names in domains.items() if config in names), None)


def paths_like(spark: SparkSession, pattern: str, include: str = "", exclude: tuple[str, ...] = ()) -> list[str]:
    """Files that match a glob, sorted, whose names hold `include` and none of `exclude`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    names = [(f.getPath().getName(), f.getPath().toString()) for f in found]
    return sorted(p for n, p in names if include in n and not any(x in n for x in exclude))


def numbered(df: DataFrame, *key: str) -> DataFrame:
    """df with row_no, 0, 1, ... by key, without one task that sees all rows: each range is numbered from its own start."""
    dealt = stash(df.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "numbered")
    starts, before = [], 0
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # one row a partition
        starts.append((r["__part"], before))
        before += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start bigint"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*key)) - 1
    return dealt.withColumn("__row", within).join(offsets, "__part").withColumn("row_no", F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def seeded_sample(df: DataFrame, n: int | None, seed: int, *key: str) -> DataFrame:
    """n rows without replacement, the same on every run; sample_no is their order. All rows if there are no more than n.

    The positions drawn are n numbers on the driver, which n itself bounds.
    """
    rows = numbered(df, *key)
    size = rows.count()
    if n is None or n >= size:
        return rows.withColumnRenamed("row_no", "sample_no")
    drawn = [(p, i) for i, p in enumerate(random.Random(seed).sample(range(size), n))]
    return rows.join(df.sparkSession.createDataFrame(drawn, "row_no bigint, sample_no bigint"), "row_no").drop("row_no")


def first_rows(df: DataFrame, n: int, *key: str) -> DataFrame:
    return df.orderBy(*key).limit(n)


def read_examples(spark: SparkSession, root: str, config: str, split: str = "test") -> DataFrame:
    """One example set, its name in _config."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, one of {list(SPLITS)} is needed")
    return spark.read.parquet(f"{root}/{config}/{split}").withColumn("_config", F.lit(config))


def read_domain(spark: SparkSession, root: str, domain: str, split: str = "test", n: int | None = None, seed: int = 42, key: str = "id", domains: dict[str, list[str]] = DOMAINS) -> DataFrame:
    """All example sets of a domain, with one sample over their union."""
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_examples(spark, root, c, split) for c in configs_for(domain, domains)])
    return seeded_sample(pool, n, seed, "_config", key)


def read_matrices(spark: SparkSession, *paths: str) -> DataFrame:
    """Result files of any age (columns they lack are null), of rows with one name and domain the last, at the place of
    the first: file_no and line_no.

    A result file has a row for each configuration and domain, so it is read as one partition.
    """
    every = []
    for i, path in enumerate(paths):
        raw = spark.read.option("header", True).csv(path).coalesce(1)
        given = raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MATRIX])
        every.append(given.withColumn("file_no", F.lit(i)).withColumn("line_no", F.monotonically_increasing_id()))
    return keep_last(reduce(DataFrame.unionByName, every), [F.coalesce("config_name", "config_id"), F.col("domain")], ["file_no", "line_no"])


def keep_last(df: DataFrame, by: list, order: list[str]) -> DataFrame:
    """Of rows with equal keys the last one; its order columns say where the first one stood."""
    keys = [F.lit(None) if b is None else b for b in by]
    rest = F.struct(*[c for c in df.columns if c not in order])
    place = F.struct(*order)
    kept = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(rest, place).alias("r"), F.min(place).alias("p"))
    return kept.select("r.*", "p.*").select(*df.columns)


def slug(c: Column) -> Column:
    """A name for files: other characters as one hyphen, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


def shortened(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...(+"), (F.length(c) - limit).cast("string"), F.lit(" chars)"))).otherwise(c)


def trace_records(answers: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One record an answered example. answers: config_name, domain, example_index, id, _config, question, answer, needs_retrieval, sources, context, scores.
    costs: the one row of cost_state(), written into each record. Without it, a column `cost` of answers is what it cost up
    to that record (see ledger.Budget), and without that the cost is zero."""
    if costs is None and "cost" not in answers.columns:
        costs = answers.sparkSession.range(1).select(F.lit(0.0).alias("total_usd"), *[F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("calls", "in_tokens", "out_tokens")]).alias(leg) for leg in ("gen", "judge")])
    figures = [F.col("total_usd"), *[F.col(f"{leg}.{c}").alias(f"{leg}_{c}") for leg, c in (("gen", "calls"), ("judge", "calls"), ("gen", "in_tokens"), ("gen", "out_tokens"), ("judge", "in_tokens"), ("judge", "out_tokens"))]]
    short = lambda c: shortened(F.coalesce(F.col(c), F.lit("")))
    whole = answers if costs is None else answers.drop("cost").join(F.broadcast(costs.select(F.struct(*figures).alias("cost"))))  # one row
    return whole.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"),
        "config_name", "domain", "example_index",
        F.coalesce(F.when(F.col("id").cast("string") != "", F.col("id").cast("string")), F.concat(F.coalesce("_config", F.lit("")), F.lit("_"), F.col("example_index").cast("string"))).alias("example_id"),
        short("question").alias("question"), short("answer").alias("answer"), F.coalesce("needs_retrieval", F.lit(True)).alias("needs_retrieval"),
        F.coalesce(F.when(F.col("sources").isNotNull(), F.size("sources")), F.lit(0)).alias("n_sources"), F.coalesce(F.length("context"), F.lit(0)).alias("context_chars"), "scores", "cost",
    )


def write_traces(records: DataFrame, path: str) -> None:
    """JSON lines, a folder for each configuration and domain."""
    named = records.withColumn("config", slug(F.col("config_name"))).withColumn("part_of", slug(F.col("domain")))
    named.write.mode("append").partitionBy("config", "part_of").json(path)


def append_rows(rows: DataFrame, path: str, schema: t.StructType, key: list[str]) -> None:
    """Rows whose key the table at path does not have yet. A call that is repeated after a crash, or made by several writers
    at once, adds nothing twice; see Committed."""
    from grainfold.sources.committed import Committed

    Committed(rows.sparkSession, path, schema).append(rows, key)


def appended_rows(spark: SparkSession, path: str, schema: t.StructType) -> DataFrame:
    from grainfold.sources.committed import Committed

    return Committed(spark, path, schema).read()


def append_matrix(rows: DataFrame, path: str) -> None:
    """Rows not yet in the matrix at path, by name (or id, if it has no name) and domain."""
    append_rows(rows, path, MATRIX, ["config_name", "config_id", "domain"])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """What append_matrix() has written at path; no rows if nothing."""
    return appended_rows(spark, path, MATRIX)


def report_schema() -> t.StructType:
    text = {"model", "prompt_variant", "domain", "config"}
    return t.StructType([t.StructField(c, t.StringType() if c in text else t.LongType() if c.startswith("n") else t.DoubleType()) for c in REPORT])


def append_reports(rows: DataFrame, path: str) -> None:
    """A judge's reports, by model, variant and example set."""
    append_rows(rows, path, report_schema(), ["model", "prompt_variant", "config"])


def report_path(root: str, model: str, variant: str, n: int) -> str:
    """One place for each model, variant and sample size, so that runs side by side do not meet."""
    name = re.sub("[^a-zA-Z0-9]+", "-", model).strip("-").lower()
    return f"{root}/judge_validation__{name}__{variant}__n{n}"


def append_usage(calls: DataFrame, path: str) -> None:
    """Model calls (leg, call_no, model, in_tokens, out_tokens); their sums are the state of costs, see cost_state()."""
    calls.select("leg", "call_no", "model", "in_tokens", "out_tokens").write.mode("append").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """All calls so far; lines that cannot be read, and missing counts, are no calls and zeros."""
    schema = "leg string, call_no bigint, model string, in_tokens bigint, out_tokens bigint"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).fillna(0, ["in_tokens", "out_tokens"])


def write_state(state: DataFrame, path: str) -> None:
    """One row as a JSON file. The files are written beside the old ones and become visible together."""
    state.coalesce(1).write.mode("overwrite").json(path)


def pending(grid: DataFrame, done: DataFrame | None, *key: str) -> DataFrame:
    """Cells of the grid without a result; nulls are equal to nulls."""
    if done is None:
        return grid
    known = done.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return grid.join(known, same, "left_anti")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A report as one CSV file with a header; null is empty. Reports have a row a configuration, domain or metric."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
