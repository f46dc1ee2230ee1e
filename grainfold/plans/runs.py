"""Queries: whole experiments, costs and events."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.config import configured
from grainfold.operators import experiments, models
from grainfold.plans import base as B
from grainfold.plans import experiment, ledger
from grainfold.plans.base import query, table
from grainfold.session import scratch_dir
from grainfold.sources import tables
from grainfold.streaming import usage

COMMON = {"domain": "all", "embedder": {"type": "hashing"}, "generator": {"type": "echo"}, "splitter": {"type": "regex"}}
POOLED = COMMON | {
    "chunker": {"type": "fixed", "size": 64, "overlap": 8}, "index": {"type": "faiss", "corpus_mode": "pooled"}, "retriever": {"type": "bm25", "k": 8},
    "reranker": {"type": "none", "top_n": 3}, "repacker": {"type": "reverse"}, "prompt": {"type": "minimal"}, "query_classifier": {"type": "heuristic"},
}
OWN = COMMON | {
    "chunker": {"type": "sac", "size": 400, "overlap": 100}, "index": {"type": "faiss", "corpus_mode": "per_example"}, "retriever": {"type": "bm25", "k": 6},
    "reranker": {"type": "lexical", "top_n": 4}, "repacker": {"type": "sides"}, "summarizer": {"type": "none"}, "prompt": {"type": "grounded"},
}


def questions(spark, sf_dir) -> DataFrame:
    """Each item of the benchmark; items of an odd number greet."""
    asked = F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("hello, "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), asked.alias("question"))


def own_documents(spark, sf_dir) -> DataFrame:
    """The documents whose number falls to an item, one a row, in the order of their numbers."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    dealt = docs.join(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("example_id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    return dealt.join(items.select(F.col("item_id").alias("example_id")), "example_id", "left_semi")


def chunk_windows(size: str, step: int, n: str) -> str:
    return f"unnest(generate_series(0, greatest(0, ceil(({n} - {size}) / {step}.0)::INT)))"


ASKED = """n AS (SELECT count(*) AS n FROM benchmark), e AS (SELECT item_id AS example_id, CASE WHEN item_id % 2 = 1 THEN 'hello, ' || text ELSE text END AS question FROM benchmark),
own AS (SELECT doc_id % n AS example_id, row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) - 1 AS pos, coalesce(text, '') AS text FROM documents, n WHERE doc_id % n IN (SELECT item_id FROM benchmark))"""
#: From the chosen chunks (example_id, place, text) on: context, prompt, echo and the fake judge's scores.
ANSWERED = f"""s AS (SELECT example_id, count(*) AS n_sources, string_agg(text, chr(10) ORDER BY place) AS context, string_agg('[' || (place + 1) || '] ' || text, chr(10) ORDER BY place) AS numbered, sum(len({B.sentences("text")})) AS t FROM chosen GROUP BY example_id),
p AS (SELECT e.example_id, question, coalesce(n_sources, 0)::INT AS n_sources, coalesce(context, '') AS context, {{head}} || 'Context:' || chr(10) || coalesce(numbered, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt, coalesce(t, 0) AS t FROM e LEFT JOIN s USING (example_id)),
k AS (SELECT *, CASE WHEN t = 0 THEN 0 ELSE greatest(1, floor(t * 0.5)::INT) END AS r, CASE WHEN t = 0 THEN 0 ELSE greatest(1, floor(t * 0.34)::INT) END AS u FROM p),
a AS (SELECT *, '[ECHO] received a prompt of ' || length(prompt) || ' chars' || CASE WHEN trim(regexp_extract(prompt, '(?im)^[ \\t]*question:(.*)$', 1)) != '' THEN '; question was: ' || trim(regexp_extract(prompt, '(?im)^[ \\t]*question:(.*)$', 1)) ELSE '' END AS answer,
  CASE WHEN t = 0 THEN 0 ELSE r / t END::DOUBLE AS relevance, CASE WHEN t = 0 THEN 0 ELSE u / t END::DOUBLE AS utilization, CASE WHEN r = 0 THEN 1 ELSE least(r, u) / r END::DOUBLE AS completeness FROM k)"""
LOW = B.tokens
HELLO = "CASE WHEN regexp_matches(lower(question), 'hello|hi |hey|thanks|thank you|bye|good (morning|evening|night)') THEN false ELSE len(regexp_extract_all(question, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')) >= 3 END"

POOLED_SQL = f"""{ASKED}, u AS (SELECT text, min(struct_pack(a := example_id, b := pos)) AS met FROM own GROUP BY text), v AS (SELECT text, row_number() OVER (ORDER BY met) - 1 AS pos FROM u),
w AS (SELECT pos, {B.words("text")} AS w FROM v), c AS (SELECT pos, {chunk_windows("64", 56, "len(w)")} AS k, w FROM w WHERE len(w) > 0),
chunks AS (SELECT pos * 1000000 + k AS doc_id, array_to_string(w[k * 56 + 1 : k * 56 + 64], ' ') AS text FROM c),
{B.bm25(8, "chunks", "(SELECT example_id AS query_id, question AS text FROM e WHERE " + HELLO + ")")},
chosen AS (SELECT query_id AS example_id, count(*) OVER (PARTITION BY query_id) - 1 - rank AS place, text FROM bm25 JOIN chunks USING (doc_id) WHERE rank < 3), {ANSWERED.replace("{head}", "''")}"""

GROUNDED_HEAD = "'" + experiment.ranking.INSTRUCTIONS["grounded"].replace("'", "''") + "' || chr(10) || chr(10)"
OWN_SQL = f"""{ASKED}, t AS (SELECT example_id, pos, {B.strip("text")} AS t FROM own),
c AS (SELECT example_id, pos, t, {B.strip("replace(substring(t, 1, 150), chr(10), ' ')")} || chr(10) || chr(10) AS head, {chunk_windows("400", 300, "length(t)")} AS k FROM t WHERE t != ''),
chunks AS (SELECT example_id, pos * 1000000 + k AS doc_id, head || substring(t, k * 300 + 1, 400) AS text FROM c),
{B.bm25(6, "chunks", "(SELECT example_id AS query_id, example_id, question AS text FROM e)", corpus="example_id")},
m AS (SELECT query_id AS example_id, rank AS was, text, list_distinct({B.tokens("text")}) AS t, list_distinct({B.tokens("question")}) AS q FROM bm25 JOIN chunks ON chunks.example_id = query_id AND chunks.doc_id = bm25.doc_id JOIN e ON e.example_id = query_id),
o AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_intersect(t, q)) / sqrt(len(t)) ELSE 0 END AS score FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, was) - 1 AS rank FROM o QUALIFY rank < 4),
chosen AS (SELECT example_id, text, CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE count(*) OVER (PARTITION BY example_id) - 1 - (rank - 1) // 2 END AS place FROM b), {ANSWERED.replace("{head}", GROUNDED_HEAD)}"""
RESULT = "example_id, n_sources, md5(context) AS context_md5, md5(prompt) AS prompt_md5, answer, round(relevance, 6) AS relevance, round(utilization, 6) AS utilization, round(completeness, 6) AS completeness, true AS adherence"


def answered(spark, sf_dir, config: dict) -> DataFrame:
    out = experiment.Pipeline(configured(config)).answers(questions(spark, sf_dir), judge=models.FakeJudge(), documents=own_documents(spark, sf_dir))
    scores = [F.round(m, 6).alias(m) for m in ("relevance", "utilization", "completeness")]
    return out.select("example_id", F.size("sources").alias("n_sources"), F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"), "answer", *scores, "adherence")


@query(f"WITH {POOLED_SQL} SELECT {RESULT} FROM a")
def experiment_pooled(spark, sf_dir):
    """One experiment on a pooled index, with questions that need no retrieval."""
    return answered(spark, sf_dir, POOLED)


@query(f"WITH {OWN_SQL} SELECT {RESULT} FROM a")
def experiment_per_example(spark, sf_dir):
    """One experiment in which each question sees its own documents only."""
    return answered(spark, sf_dir, OWN)


def matrix_sql(config: dict, name: str, body: str) -> str:
    made = configured(config)
    kinds = {s: (made.types().get(s) or {"type": "none"})["type"] for s in tables.STAGES}
    known = {"config_name": name, "config_id": experiments.config_id(made.types()), "domain": made.domain, **kinds}
    columns = ", ".join(f"'{v}' AS {c}" for c, v in known.items())
    return f"SELECT {columns}, count(*) AS n, count(*) AS n_scored, round(avg(relevance), 6) AS relevance, round(avg(utilization), 6) AS utilization, round(avg(completeness), 6) AS completeness, 1.0::DOUBLE AS adherence, 'done' AS scoring FROM (WITH {body} SELECT * FROM a)"


@query(f"{matrix_sql(POOLED, 'pooled', POOLED_SQL)} UNION ALL {matrix_sql(OWN, 'own', OWN_SQL)}")
def experiment_matrix(spark, sf_dir):
    """The rows of a result matrix: every configuration over all examples."""
    rows = [experiment.run_experiment(configured(c), questions(spark, sf_dir), models.FakeJudge(), name=n, documents=own_documents(spark, sf_dir)) for n, c in (("pooled", POOLED), ("own", OWN))]
    return rows[0].unionByName(rows[1])


class Counting:
    """A client without a model: as many tokens as the prompt has bytes, and an answer of one to four tokens."""

    def complete(self, prompt: str, sample: bool = False) -> models.Completion:
        size = len(prompt.encode())
        return models.Completion("yes " * (1 + size % 4), size, 1 + size % 4, "stop")


#: What a call of Counting costs, US dollars a million tokens; half of what all turns cost together is the cap.
COUNTING = ("counting", 2.0, 5.0)
TURN = "conv_id * 1000000 + turn"


@query(f"""WITH c AS (SELECT {TURN} AS example_id, strlen('Question: ' || coalesce(text, '')) AS i FROM conversations), p AS (SELECT *, 1 + i % 4 AS o, round((i * 2.0::DOUBLE + (1 + i % 4) * 5.0::DOUBLE) / 1e6, 6) AS usd FROM c),
r AS (SELECT *, sum(usd) OVER (ORDER BY example_id ROWS UNBOUNDED PRECEDING) AS so_far, sum(usd) OVER () / 2 AS cap FROM p)
SELECT example_id, i AS in_tokens, o AS out_tokens, round(so_far, 4) AS total_usd, row_number() OVER (ORDER BY example_id) AS gen_calls FROM r WHERE round(so_far - usd, 6) <= round(cap, 6)""")
def capped_run(spark, sf_dir):
    """Turns as prompts of a model that charges, asked under a cap that ends the run halfway, at the very call that passes it."""
    prompts = table(spark, sf_dir, "conversations").select(F.expr(TURN).alias("example_id"), F.concat(F.lit("Question: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    size = F.octet_length("prompt")
    most = ledger.usd(size, 1 + size % 4, COUNTING[1:])
    cap = prompts.agg(F.round(F.sum(F.round(most, 6)) / 2, 6)).first()[0]
    budget = ledger.Budget(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}", cap or 0.0, [COUNTING], slice_rows=1 << 15)
    generator = models.Generator(Counting, charged="counting")
    none = {f"judge_{c}": F.lit(None).cast("bigint") for c in ("in_tokens", "out_tokens")}
    with contextlib.suppress(ledger.CapPassed):
        budget.run("turns", prompts, lambda rows: generator.answers(rows).withColumns(none), generator, bound=most)
    return budget.snapshot(budget.answers("turns")).select("example_id", "in_tokens", "out_tokens", F.round("cost.total_usd", 4).alias("total_usd"), "cost.gen_calls")


#: Events as calls of models that all but one have a price.
CALLS = "c AS (SELECT event_id, user_id, round((1000 + event_id % 7) * CASE event_type WHEN 'view' THEN 0.05::DOUBLE ELSE 0.59::DOUBLE END / 1e6 + (200 + event_id % 5) * CASE event_type WHEN 'view' THEN 0.08::DOUBLE ELSE 0.79::DOUBLE END / 1e6, 6) AS cost FROM events)"
PRICES = [("purchase", 0.59, 0.79), ("view", 0.05, 0.08)]


def calls(spark, sf_dir, leg: str) -> tuple[DataFrame, DataFrame]:
    made = table(spark, sf_dir, "events").selectExpr(f"{leg} AS leg", "event_id AS call_no", "event_type AS model", "1000 + event_id % 7 AS in_tokens", "200 + event_id % 5 AS out_tokens")
    return made, spark.createDataFrame(PRICES, experiments.PRICE_COLUMNS)


@query(f"""WITH {CALLS} SELECT CAST(user_id % 50 AS VARCHAR) AS leg, count(*) AS calls, sum(1000 + event_id % 7)::BIGINT AS in_tokens, sum(200 + event_id % 5)::BIGINT AS out_tokens, round(sum(cost), 3) AS cost_usd FROM c GROUP BY 1""")
def usage_cost(spark, sf_dir):
    return experiments.cost_report(experiments.priced(*calls(spark, sf_dir, "cast(user_id % 50 AS string)"))).withColumn("cost_usd", F.round("cost_usd", 3))


LEG = "CASE WHEN user_id % 3 = 0 THEN 'judge' ELSE 'gen' END"


@query(f"""WITH {CALLS}, l AS (SELECT *, {LEG} AS leg FROM c), t AS (SELECT event_id AS call_no, leg, cost AS cost_usd, round(sum(cost) OVER (PARTITION BY leg ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS leg_usd, round(sum(cost) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total_usd FROM l)
SELECT *, total_usd > 4.5 AS over_cap FROM t""")
def cost_cap(spark, sf_dir):
    priced = experiments.costs(*calls(spark, sf_dir, LEG))
    return priced.select("call_no", "leg", "cost_usd", "leg_usd", "total_usd", "over_cap")


@query(f"""WITH {CALLS}, l AS (SELECT *, {LEG} AS leg FROM c), g AS (SELECT count(*) FILTER (WHERE leg = 'gen') AS gen_calls, count(*) FILTER (WHERE leg = 'judge') AS judge_calls, round(sum(cost) FILTER (WHERE leg = 'gen'), 4) AS gen_usd, round(sum(cost) FILTER (WHERE leg = 'judge'), 4) AS judge_usd, round(sum(cost), 4) AS total_usd FROM l)
SELECT *, 'gen ' || gen_calls || ' calls $' || format('{{:.4f}}', gen_usd) || ' | judge ' || judge_calls || ' calls $' || format('{{:.4f}}', judge_usd) || ' | total $' || format('{{:.4f}}', total_usd) || ' of $4.50' AS line FROM g""")
def cost_state(spark, sf_dir):
    state = experiments.cost_state(*calls(spark, sf_dir, LEG))
    short = [F.round(c, 4).alias(n) for n, c in (("gen_usd", "gen.cost_usd"), ("judge_usd", "judge.cost_usd"), ("total_usd", "total_usd"))]
    return state.join(F.broadcast(experiments.cost_line(state))).select(F.col("gen.calls").alias("gen_calls"), F.col("judge.calls").alias("judge_calls"), *short, "line")


@query("""SELECT event_id, user_id, round(sum(value) OVER w, 4) AS total, round(sum(value) OVER w, 4) > 100 AS over_cap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_cost(spark, sf_dir):
    """Each user's total so far. Events are dealt into ranges of time, so that a busy user is many tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    rows = tables.running_totals(events, "value", "all_users", "ts", "event_id", by="user_id", by_total="mine")
    total = F.round("mine", 4)
    return rows.select("event_id", "user_id", total.alias("total"), (total > 100).alias("over_cap"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return usage.window_counts(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 2))


@query("""SELECT conv_id, turn, '[ECHO] received a prompt of ' || length('Question: ' || coalesce(text, '')) || ' chars' ||
CASE WHEN trim(split_part(coalesce(text, ''), chr(10), 1)) != '' THEN '; question was: ' || trim(split_part(text, chr(10), 1)) ELSE '' END AS answer FROM conversations""")
def echo_answers(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Question: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    return models.Echo().answers(asked).select("conv_id", "turn", "answer")


@query(f"""WITH {CALLS}, g AS (SELECT round(sum(cost), 3) AS total FROM c) SELECT conv_id || '_' || turn AS example_id, CASE WHEN length(coalesce(text, '')) > 500 THEN substring(text, 1, 500) || '...(+' || (length(text) - 500) || ' chars)' ELSE coalesce(text, '') END AS question, '' AS answer, length(coalesce(text, ''))::INT AS context_chars, total AS total_usd, '{{"relevance":0.5}}' AS scores FROM conversations, g""")
def trace_records(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("x").alias("config_name"), F.lit("all").alias("domain"), F.col("turn").alias("example_index"), F.lit(None).cast("string").alias("id"), F.col("conv_id").cast("string").alias("_config"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(True).alias("needs_retrieval"), F.lit(None).cast("array<string>").alias("sources"), F.col("text").alias("context"), F.struct(F.lit(0.5).alias("relevance")).alias("scores"),
    )
    records = tables.trace_records(turns, experiments.cost_state(*calls(spark, sf_dir, LEG)))
    return records.select("example_id", "question", "answer", "context_chars", F.round("cost.total_usd", 3).alias("total_usd"), F.to_json("scores").alias("scores"))
