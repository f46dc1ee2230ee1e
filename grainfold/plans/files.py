"""Queries that go through files: example sets, result matrices, usage, reports and a stream. They write to scratch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions.text import strip
from grainfold.operators import experiments
from grainfold.plans import base as B
from grainfold.plans.base import query, table
from grainfold.plans.runs import CALLS, LEG, calls
from grainfold.plans.scores import GROUNDING, grounded
from grainfold.session import scratch_dir
from grainfold.sources import tables
from grainfold.streaming import usage


def place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


LANGUAGES = {"Romance": ["fr", "es"], "Germanic": ["en", "de"]}


@query("SELECT doc_id AS id, lang AS _config, md5(text) AS text_md5 FROM documents WHERE lang IN ('fr', 'es')")
def domain_examples(spark, sf_dir):
    """Example sets, one a language, read as one domain."""
    root = place(spark, "sets")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.md5("text").alias("text_md5"))
    for names in LANGUAGES.values():
        for lang in names:
            docs.where(F.col("lang") == lang).drop("lang").write.parquet(f"{root}/{lang}/test")
    return tables.read_domain(spark, root, "Romance", domains=LANGUAGES).drop("sample_no")


@query()
def seeded_sample(spark, sf_dir):
    """A hundred documents, the same ones on every run."""
    return tables.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), 100, 42, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    return tables.first_rows(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


def matrix(rows: DataFrame) -> DataFrame:
    cells = experiments.means(rows, "source", "lang").withColumnsRenamed({"source": "config_id", "lang": "domain"})
    return cells.select(*[F.col(f.name).cast(f.dataType) if f.name in cells.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.MATRIX])


CELLS = f"{GROUNDING}, m AS (SELECT source AS config_id, lang AS domain, count(*) AS n, round(avg(relevance), 6) AS relevance, round(avg(adherence::INT), 6) AS adherence FROM s GROUP BY ALL)"


@query(f"WITH {CELLS} SELECT config_id, domain, n, relevance, adherence, 'done' AS scoring FROM m")
def appended_matrix(spark, sf_dir):
    """A result matrix in two parts, of which the second repeats cells of the first."""
    path, rows = place(spark, "matrix"), matrix(grounded(spark, sf_dir))
    tables.append_matrix(rows.where("domain = 'en'"), path)
    tables.append_matrix(rows, path)
    return tables.read_matrix(spark, path).select("config_id", "domain", "n", "relevance", "adherence", "scoring")


@query(f"WITH {CELLS} SELECT config_id, domain, n + CASE WHEN domain = 'en' THEN 1000 ELSE 0 END AS n, relevance, CASE WHEN domain = 'en' THEN NULL ELSE adherence END AS adherence FROM m")
def merged_matrices(spark, sf_dir):
    """Two result files, the newer one with other figures for some cells and without a column."""
    root, rows = place(spark, "csv"), matrix(grounded(spark, sf_dir))
    tables.write_csv(rows, f"{root}/a_1.csv")
    tables.write_csv(rows.where("domain = 'en'").withColumn("n", F.col("n") + 1000), f"{root}/a_2.csv", [c for c in rows.columns if c not in ("adherence", "config_name")])
    tables.write_csv(rows.withColumn("n", F.lit(0)), f"{root}/b_old.csv")
    return tables.read_matrices(spark, *tables.paths_like(spark, f"{root}/*.csv", "a_", ("old",))).select("config_id", "domain", "n", "relevance", "adherence")


@query(f"""WITH {CALLS}, l AS (SELECT *, {LEG} AS leg FROM c) SELECT leg, count(*) AS calls, round(sum(cost), 3) AS cost_usd FROM l GROUP BY leg""")
def usage_files(spark, sf_dir):
    """Calls appended to a usage log in two parts and read again."""
    path = place(spark, "usage")
    made, prices = calls(spark, sf_dir, LEG)
    for part in (0, 1):
        tables.append_usage(made.where(F.col("call_no") % 2 == part), path)
    legs = experiments.cost_report(experiments.priced(tables.read_usage(spark, path), prices))
    return legs.select("leg", "calls", F.round("cost_usd", 3).alias("cost_usd"))


@query(f"""WITH {CALLS}, l AS (SELECT *, {LEG} AS leg FROM c) SELECT leg, count(*) AS calls, round(sum(cost), 3) AS cost_usd FROM l GROUP BY leg""")
def streamed_cost(spark, sf_dir):
    """The same calls as a stream of JSON files, with the state of each leg kept from one batch to the next."""
    source, target = place(spark, "calls"), place(spark, "costs")
    made, prices = calls(spark, sf_dir, LEG)
    made.select("leg", "model", "in_tokens", "out_tokens", F.current_timestamp().alias("ts")).repartition(3).write.json(source)
    running = usage.running_cost(usage.call_stream(spark, source), prices).writeStream.outputMode("complete")
    sink = running.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(target))
    sink.option("checkpointLocation", place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("leg string, calls bigint, cost_usd double").parquet(target).withColumn("cost_usd", F.round("cost_usd", 3))


@query(f"""WITH t AS (SELECT lower(regexp_replace(regexp_replace(source, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS config, lang AS part_of, length({B.strip("coalesce(text, '')")})::BIGINT AS context_chars FROM documents)
SELECT config, part_of, count(*) AS n, sum(context_chars)::BIGINT AS context_chars FROM t GROUP BY ALL""")
def trace_files(spark, sf_dir):
    """Traces as JSON lines in a folder a configuration and domain, read again."""
    path = place(spark, "traces")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("source").alias("config_name"), F.col("lang").alias("domain"), F.col("doc_id").alias("example_index"), F.lit(None).cast("string").alias("id"), F.lit("s").alias("_config"), F.lit("q").alias("question"),
        F.lit("a").alias("answer"), F.lit(True).alias("needs_retrieval"), F.lit(None).cast("array<string>").alias("sources"), strip(F.coalesce("text", F.lit(""))).alias("context"), F.lit(None).cast("string").alias("scores"),
    )
    tables.write_traces(tables.trace_records(rows), path)
    found = spark.read.schema("example_id string, context_chars bigint, config string, part_of string").json(path)
    return found.groupBy("config", "part_of").agg(F.count(F.lit(1)).alias("n"), F.sum("context_chars").alias("context_chars"))
