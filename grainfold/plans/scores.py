"""Queries: judged answers, scores, their agreement, gaps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators import evaluation, experiments, judging
from grainfold.plans import base as B
from grainfold.plans.base import query, table
from grainfold.session import ship_package
from grainfold.sources import tables

#: Documents as judged examples: the first half of the sentences is relevant, a third is used, and as many sentences of
#: the answer as the last digit of the id says, if that is under 3, are not supported.
GROUNDING = f"""d AS (SELECT doc_id, source, lang, len({B.sentences("text")}) AS t FROM documents),
k AS (SELECT *, CASE WHEN t = 0 THEN 0 ELSE greatest(1, floor(t * 0.5)::INT) END AS r, CASE WHEN t = 0 THEN 0 ELSE greatest(1, floor(t * 0.34)::INT) END AS u FROM d),
s AS (SELECT *, CASE WHEN t = 0 THEN 0 ELSE r / t END::DOUBLE AS relevance, CASE WHEN t = 0 THEN 0 ELSE u / t END::DOUBLE AS utilization, CASE WHEN r = 0 THEN 1 ELSE least(r, u) / r END::DOUBLE AS completeness, doc_id % 10 NOT IN (1, 2) AS adherence FROM k)"""


def examples(spark, sf_dir) -> DataFrame:
    """Documents with gold labels and shipped reference scores (rounded ones, and a relevance that every seventh lacks)."""
    keyed = T.keyed_documents(F.array(T.sentences(F.coalesce("text", F.lit("")))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", keyed.alias("documents_sentences"))
    keys = F.transform(F.flatten("documents_sentences"), lambda k: k["key"])
    digit = (F.col("doc_id") % 10).cast("int")
    labels = {
        "all_relevant_sentence_keys": evaluation.first_keys(keys, 0.5), "all_utilized_sentence_keys": evaluation.first_keys(keys, 0.34),
        "unsupported_response_sentence_keys": F.when(digit.isin(1, 2), F.array_repeat(F.lit("a"), digit)).otherwise(F.array().cast("array<string>")),
    }
    return docs.withColumns(labels)


def grounded(spark, sf_dir) -> DataFrame:
    return evaluation.gold_scores(examples(spark, sf_dir)).select("doc_id", "source", "lang", *evaluation.METRICS, "adherence")


def referenced(spark, sf_dir) -> DataFrame:
    """Own scores beside reference scores."""
    rows = grounded(spark, sf_dir)
    refs = {f"{m}_ref": F.round(m, 1) for m in evaluation.METRICS} | {"adherence_ref": F.col("doc_id") % 5 != 1}
    return rows.withColumns(refs)


REFERENCED = f"{GROUNDING}, x AS (SELECT *, round(relevance, 1) AS relevance_ref, round(utilization, 1) AS utilization_ref, round(completeness, 1) AS completeness_ref, doc_id % 5 != 1 AS adherence_ref FROM s)"


@query(f"WITH {GROUNDING} SELECT doc_id, round(relevance, 6) AS relevance, round(utilization, 6) AS utilization, round(completeness, 6) AS completeness, adherence FROM s")
def grounding_scores(spark, sf_dir):
    return grounded(spark, sf_dir).select("doc_id", *[F.round(m, 6).alias(m) for m in evaluation.METRICS], "adherence")


@query(f"""WITH {REFERENCED}, y AS (SELECT source, relevance - relevance_ref AS d FROM x)
SELECT source, count(*) AS n_scored, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(avg(d), 6) + 0 AS signed, round(max(abs(d)), 6) AS max_gap FROM y GROUP BY source""")
def score_agreement(spark, sf_dir):
    return evaluation.agreement(referenced(spark, sf_dir), "relevance", "relevance_ref", "source").withColumn("signed", F.col("signed") + 0)


VALIDATED = ", ".join(f"round(sqrt(avg(({m} - {m}_ref) * ({m} - {m}_ref))), 6) AS {m}_rmse, round(max(abs({m} - {m}_ref)), 6) AS {m}_max_gap, count(*) FILTER (WHERE abs({m} - {m}_ref) < 1e-9) AS {m}_exact" for m in evaluation.METRICS)


@query(f"WITH {REFERENCED} SELECT lang, source, count(*) AS n, {VALIDATED}, count(*) FILTER (WHERE adherence = adherence_ref) AS adherence_correct, round(avg((adherence = adherence_ref)::INT), 6) AS adherence_accuracy FROM x GROUP BY lang, source")
def validation_report(spark, sf_dir):
    return evaluation.validation(referenced(spark, sf_dir), "lang", "source")


@query(f"""WITH {GROUNDING}, m AS (SELECT source, lang, avg(relevance) AS relevance, avg(utilization) AS utilization, avg(completeness) AS completeness FROM s GROUP BY ALL),
r AS (SELECT lang, avg(relevance) AS r1, avg(utilization) AS r2, avg(completeness) AS r3 FROM s GROUP BY lang),
g AS (SELECT unnest(['relevance', 'utilization', 'completeness']) AS metric, unnest([relevance - r1, utilization - r2, completeness - r3]) AS gap FROM m JOIN r USING (lang))
SELECT metric, count(*) AS n_cells, round(avg(gap), 6) + 0 AS bias, round(stddev_pop(gap), 6) AS spread, round(min(gap), 6) AS gap_min, round(max(gap), 6) AS gap_max FROM g GROUP BY metric""")
def gap_summary(spark, sf_dir):
    rows = grounded(spark, sf_dir)
    ours = rows.groupBy("source", "lang").agg(*[F.avg(m).alias(m) for m in evaluation.METRICS])
    theirs = rows.groupBy("lang").agg(*[F.avg(m).alias(f"{m}_ref") for m in evaluation.METRICS])
    return evaluation.gap_summary(ours.join(theirs, "lang").select(*[(F.col(m) - F.col(f"{m}_ref")).alias(f"{m}_gap") for m in evaluation.METRICS]))


@query(f"""WITH {GROUNDING} SELECT source, round(avg(relevance) FILTER (WHERE lang = 'de'), 3) AS de, round(avg(relevance) FILTER (WHERE lang = 'en'), 3) AS en, round(avg(relevance) FILTER (WHERE lang = 'es'), 3) AS es, round(avg(relevance) FILTER (WHERE lang = 'fr'), 3) AS fr FROM s GROUP BY source""")
def score_pivot(spark, sf_dir):
    return grounded(spark, sf_dir).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg("relevance"), 3))


#: A matrix with a row a source and language against means of the languages; es has no reference.
MATRIX = f"""{GROUNDING}, m AS (SELECT source || '.yaml' AS config, lang AS domain, count(*) AS n, round(avg(relevance), 6) AS relevance, round(avg(utilization), 6) AS utilization, round(avg(completeness), 6) AS completeness, round(avg(adherence::INT), 6) AS adherence FROM s GROUP BY ALL),
r AS (SELECT lang AS domain, avg(relevance) AS relevance_ref, avg(utilization) AS utilization_ref, avg(completeness) AS completeness_ref, avg(adherence::INT) AS adherence_ref FROM s WHERE lang != 'es' GROUP BY lang)"""


def compared(spark, sf_dir) -> DataFrame:
    rows = grounded(spark, sf_dir).withColumnsRenamed({"lang": "domain"})
    matrix = experiments.means(rows.withColumn("config", F.concat("source", F.lit(".yaml"))), "config", "domain")
    shipped = rows.where("domain != 'es'").withColumnsRenamed({m: c for m, c in evaluation.REFERENCE.items()}).withColumn("adherence_score", F.col("adherence_score").cast("int"))
    return experiments.comparison(matrix, evaluation.reference_means(shipped, "domain").drop("n"), "domain")


GAPS = ", ".join(f"round({m}_ref, 6) AS {m}_ref, round({m} - {m}_ref, 6) + 0 AS {m}_gap" for m in tables.SCORES)


@query(f"WITH {MATRIX} SELECT regexp_replace(config, '\\.yaml$', '') AS label, domain, n, relevance, utilization, completeness, adherence, {GAPS} FROM m LEFT JOIN r USING (domain)")
def reference_comparison(spark, sf_dir):
    rounded = {f"{m}_ref": F.round(f"{m}_ref", 6) for m in tables.SCORES} | {f"{m}_gap": F.col(f"{m}_gap") + 0 for m in tables.SCORES}
    rows = compared(spark, sf_dir).withColumns(rounded).withColumn("label", experiments.label(F.col("config"), F.lit(None)))
    return rows.drop("config", "n_scored", "scoring")


@query(f"""WITH {MATRIX}, c AS (SELECT * FROM m LEFT JOIN r USING (domain)), l AS ({" UNION ALL ".join(f"SELECT config, domain, '{m}' AS metric, {m} AS ours, {m}_ref AS reference FROM c" for m in tables.SCORES)})
SELECT config, domain, metric, round(ours, 3) AS ours, round(reference, 3) AS reference, CASE WHEN reference IS NULL THEN '' ELSE format('{{:+.3f}}', round(ours - reference, 6) + 0) END AS gap FROM l""")
def gap_table(spark, sf_dir):
    rows = compared(spark, sf_dir)
    return evaluation.gap_table(rows.withColumns({f"{m}_gap": F.col(f"{m}_gap") + 0 for m in tables.SCORES}), "config", "domain")


@query(f"""WITH {MATRIX}, c AS (SELECT * FROM m LEFT JOIN r USING (domain)), l AS ({" UNION ALL ".join(f"SELECT config, domain, '{m}' AS metric, 'ours' AS series, {m} AS value FROM c UNION ALL SELECT config, domain, '{m}', 'reference', {m}_ref FROM c" for m in tables.SCORES)})
SELECT config, domain, metric, series, round(value, 6) AS value FROM l WHERE value IS NOT NULL""")
def plot_rows(spark, sf_dir):
    return evaluation.plot_rows(compared(spark, sf_dir), "config", "domain").withColumn("value", F.round("value", 6))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_pending(spark, sf_dir):
    return tables.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def answers(spark, sf_dir) -> DataFrame:
    """A judge's answers on the documents: plain, fenced with quotes to repair, without a label, inside prose, with a null
    list; their keys and verdicts depend on the document."""
    keys = lambda share: F.transform(evaluation.first_keys(F.transform(F.flatten("documents_sentences"), lambda k: k["key"]), share), lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    listed = lambda share: F.concat(F.lit("["), F.array_join(keys(share), ", "), F.lit("]"))
    relevant, utilized = listed(0.5), listed(0.34)
    true = F.when(F.col("doc_id") % 3 == 0, "true").when(F.col("doc_id") % 3 == 1, "false").otherwise('"false"')
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    whole = F.concat(F.lit("{"), field(judging.RELEVANT, relevant), F.lit(", "), field(judging.UTILIZED, utilized), F.lit(", "), field(judging.SUPPORTED, true), F.lit("}"))
    fenced = F.concat(F.lit("Here:\n```json\n{"), field(judging.RELEVANT, relevant), F.lit(', "why": "it says "no" here", '), field(judging.SUPPORTED, true), F.lit("}\n```"))
    prose = F.concat(F.lit("So {"), field(judging.UTILIZED, utilized), F.lit("} it is"))
    null = F.concat(F.lit("{"), field(judging.RELEVANT, F.lit("null")), F.lit("}"))
    kind = F.pmod(F.col("doc_id"), F.lit(5)).cast("int")
    docs = examples(spark, sf_dir).withColumn("n_sentences", judging.total_sentences(F.col("documents_sentences")))
    return docs.select("doc_id", "source", "n_sentences", F.array(whole, fenced, F.lit("none"), prose, null)[kind].alias("answer"))


JUDGED = f"""{GROUNDING}, a AS (SELECT doc_id, source, t, CASE doc_id % 5 WHEN 0 THEN r WHEN 1 THEN r WHEN 3 THEN 0 END AS r, CASE doc_id % 5 WHEN 0 THEN u WHEN 1 THEN 0 WHEN 3 THEN u END AS u, CASE doc_id % 5 WHEN 3 THEN false WHEN 0 THEN doc_id % 3 != 1 WHEN 1 THEN doc_id % 3 != 1 END AS adherence, doc_id % 5 IN (2, 4) AS failed FROM k),
j AS (SELECT doc_id, source, CASE WHEN failed THEN NULL WHEN t = 0 THEN 0 ELSE r / t END::DOUBLE AS relevance, CASE WHEN failed THEN NULL WHEN t = 0 THEN 0 ELSE u / t END::DOUBLE AS utilization, CASE WHEN failed THEN NULL WHEN r = 0 THEN 1 ELSE least(r, u) / r END::DOUBLE AS completeness, adherence, failed FROM a)"""


def judged(spark, sf_dir) -> DataFrame:
    ship_package(spark)
    return judging.scored(answers(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT doc_id, round(relevance, 6) AS relevance, round(utilization, 6) AS utilization, round(completeness, 6) AS completeness, adherence, failed FROM j")
def judge_scores(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", *[F.round(m, 6).alias(m) for m in evaluation.METRICS], "adherence", "failed")


REPORTED = ", ".join(f"round(coalesce(sqrt(avg({d} * {d}) FILTER (WHERE NOT failed)), 0), 6) AS {m}_rmse, round(coalesce(avg(abs({d})) FILTER (WHERE NOT failed), 0), 6) AS {m}_mae, round(coalesce(avg({d}) FILTER (WHERE NOT failed), 0), 6) + 0 AS {m}_signed" for m in evaluation.METRICS for d in [f"(j.{m} - s.{m})"])
REPORT = f"""{JUDGED}, report AS (SELECT j.source, count(*) AS n, count(*) FILTER (WHERE NOT failed) AS n_scored, count(*) FILTER (WHERE failed) AS n_failed, {REPORTED},
round(coalesce(avg((j.adherence = s.adherence)::INT) FILTER (WHERE NOT failed), 0), 6) AS adherence_acc, round(coalesce(avg((NOT j.adherence AND s.adherence)::INT) FILTER (WHERE NOT failed), 0), 6) AS adherence_over_flag, round(coalesce(avg((j.adherence AND NOT s.adherence)::INT) FILTER (WHERE NOT failed), 0), 6) AS adherence_under_flag FROM j JOIN s USING (doc_id) GROUP BY j.source)"""


def report(spark, sf_dir) -> DataFrame:
    gold = grounded(spark, sf_dir).select("doc_id", *[F.col(m).alias(f"{m}_ref") for m in tables.SCORES])
    found = judging.judge_report(judged(spark, sf_dir).join(gold, "doc_id"), "source")
    return found.withColumns({f"{m}_signed": F.col(f"{m}_signed") + 0 for m in evaluation.METRICS})


@query(f"WITH {REPORT} SELECT * FROM report")
def judge_report(spark, sf_dir):
    return report(spark, sf_dir)


@query(f"""WITH {REPORT} SELECT 'm' AS model, 'baseline' AS prompt_variant, count(*) AS configs, round(avg(relevance_rmse), 3) AS relevance_rmse, round(avg(relevance_signed), 3) + 0 AS relevance_signed, round(avg(utilization_rmse), 3) AS utilization_rmse, round(avg(completeness_rmse), 3) AS completeness_rmse, round(avg(adherence_acc), 3) AS adherence_acc FROM report""")
def judge_verdict(spark, sf_dir):
    new = report(spark, sf_dir).select(F.lit("m").alias("model"), F.col("source").alias("config"), "*")
    old = new.withColumns({"relevance_rmse": F.lit(9.0), "prompt_variant": F.lit("baseline")})
    return judging.judge_verdict(old, new).withColumn("relevance_signed", F.col("relevance_signed") + 0)


@query("""WITH g AS (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'length' ELSE 'stop' END AS reason, (event_id * 7 % 260)::INT AS n FROM events), c AS (SELECT event_type, reason = 'length' OR n >= 240 AS cut, n FROM g)
SELECT event_type, round(avg(cut::INT), 6) AS truncated, (list_sort(list(n)))[1 + count(*) // 2]::BIGINT AS median_tokens, avg(cut::INT) >= 0.2 AS cap_binds FROM c GROUP BY event_type""")
def length_cap(spark, sf_dir):
    generated = table(spark, sf_dir, "events").selectExpr("event_type", "IF(event_id % 9 = 0, 'length', 'stop') AS done_reason", "event_id * 7 % 260 AS n_tokens")
    return experiments.length_cap(generated, 256, "event_type")
