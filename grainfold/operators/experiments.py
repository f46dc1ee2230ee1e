"""Experiments as tables: the grid of configurations and domains, their scores, references, gaps and costs."""

from __future__ import annotations

from collections import Counter
from copy import deepcopy
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.operators.evaluation import METRICS
from grainfold.session import sized
from grainfold.sources.tables import STAGES, running_totals

REQUIRED = [s for s in STAGES if s not in ("reranker", "repacker", "summarizer")]


def config_id(config: dict) -> str:
    """The types of the stages; none for those left out."""
    missing = [s for s in REQUIRED if not config.get(s)]
    if missing:
        raise ValueError(f"stages without a type: {missing}")
    return "|".join((config.get(s) or {"type": "none"})["type"] for s in STAGES)


def grid(configs: dict[str, dict], domains: list[str], generator: dict | None = None) -> list[tuple[str, dict]]:
    """(name, configuration) for every configuration and domain; two of one id and domain are an error."""
    cells = [(name, deepcopy(c) | {"domain": d} | ({"generator": generator} if generator else {})) for (name, c), d in product(configs.items(), domains)]
    twice = [k for k, n in Counter((config_id(c), c["domain"]) for _, c in cells).items() if n > 1]
    if twice:
        raise ValueError(f"configurations that cannot be told apart: {twice}")
    return cells


def means(rows: DataFrame, *by: str) -> DataFrame:
    """Mean scores; n_scored counts rows with scores; without any, the scoring is pending."""
    n = F.count("relevance")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n.alias("n_scored"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
        F.round(F.avg(F.col("adherence").cast("int")), 6).alias("adherence"), F.when(n > 0, "done").otherwise("pending (no judge)").alias("scoring"),
    )


def mean_cube(rows: DataFrame, *by: str) -> DataFrame:
    """means() over every subset of `by` in one pass: each row is expanded before partial aggregation, which leaves a row a group
    and task. part_of says which columns are summed over (bits, the first column's the highest), so that a null value and
    "all" can be told apart."""
    return summed(rows.cube(*by))


def summed(grouped) -> DataFrame:
    n = F.count("relevance")
    return grouped.agg(
        F.grouping_id().cast("int").alias("part_of"), F.count(F.lit(1)).alias("n"), n.alias("n_scored"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
        F.round(F.avg(F.col("adherence").cast("int")), 6).alias("adherence"),
    )


def mean_rollup(rows: DataFrame, *by: str) -> DataFrame:
    """The same over by, all but the last, ..., and over everything."""
    return summed(rows.rollup(*by))


def comparison(matrix: DataFrame, reference: DataFrame, *key: str) -> DataFrame:
    """matrix with {metric}_ref and {metric}_gap side by side; null where there is no reference or no score.

    The reference has a row a domain and sample size at most, the matrix one a configuration and domain.
    """
    names = (*METRICS, "adherence")
    ref = reference.select(*key, *[F.col(m).alias(f"{m}_ref") for m in names])
    gap = lambda m: F.round(F.col(m).cast("double") - F.col(f"{m}_ref"), 6)
    pairs = [c for m in names for c in (F.col(f"{m}_ref"), gap(m).alias(f"{m}_gap"))]
    return matrix.join(ref, list(key), "left").select(*matrix.columns, *pairs)


def label(name: Column, config: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, config, F.lit("")), r"\.yaml$", "")


#: Prices (US dollars a million tokens, in and out) and what a run may cost.
PRICES = [
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("llama-3.1-70b-versatile", 0.59, 0.79),
    ("llama-3.1-8b-instant", 0.05, 0.08),
]
CAP_USD = 4.50
PRICE_COLUMNS = "model string, price_in double, price_out double"


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost_usd, to six places. An unknown model costs as much as the dearest one, for each side.
    prices (model, price_in, price_out): a table of models, broadcast if it is as small as that."""
    top = prices.agg(F.max("price_in").alias("top_in"), F.max("price_out").alias("top_out"))
    met = calls.join(sized(prices, 100_000), "model", "left").join(F.broadcast(top), how="cross")  # one row
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = (tokens("in_tokens") * F.coalesce("price_in", "top_in") + tokens("out_tokens") * F.coalesce("price_out", "top_out")) / 1e6
    return met.select(*calls.columns, F.round(cost, 6).alias("cost_usd"))


def costs(calls: DataFrame, prices: DataFrame, cap: float = CAP_USD) -> DataFrame:
    """calls (leg, call_no, model, in_tokens, out_tokens) with cost, the leg's and all legs' running totals by call_no, and
    whether all of them together are above the cap. No task sees more than its range of calls."""
    legs = running_totals(priced(calls, prices), "cost_usd", "total_usd", "call_no", by="leg", by_total="leg_usd")
    return legs.select(*calls.columns, "cost_usd", F.round("leg_usd", 6).alias("leg_usd"), F.round("total_usd", 6).alias("total_usd"), (F.round("total_usd", 6) > cap).alias("over_cap"))


def cost_report(priced: DataFrame) -> DataFrame:
    return priced.groupBy("leg").agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def cost_state(calls: DataFrame, prices: DataFrame, cap: float = CAP_USD) -> DataFrame:
    """One row: what each leg and all together cost so far. A leg without calls has zeros."""
    legs = cost_report(priced(calls.where(F.col("leg").isin("gen", "judge")), prices))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    leg = lambda name: F.struct(
        *[zero(F.max(F.when(F.col("leg") == name, F.col(c)))).alias(c) for c in ("calls", "in_tokens", "out_tokens")],
        F.coalesce(F.max(F.when(F.col("leg") == name, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
    ).alias(name)
    total = F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6)
    return legs.agg(leg("gen"), leg("judge"), total.alias("total_usd"), F.lit(cap).alias("hard_cap_usd"))


def cost_line(state: DataFrame) -> DataFrame:
    """The state in one line of text."""
    part = lambda leg: F.format_string(f"{leg} %d calls $%.4f", F.col(f"{leg}.calls"), F.col(f"{leg}.cost_usd"))
    return state.select(F.concat_ws(" | ", part("gen"), part("judge"), F.format_string("total $%.4f of $%.2f", "total_usd", "hard_cap_usd")).alias("line"))


def length_cap(generated: DataFrame, cap: int, *by: str) -> DataFrame:
    """How often answers (done_reason, n_tokens) end at the length limit, and their upper median; from a fifth on, the cap binds."""
    cut = (F.col("done_reason") == "length") | (F.col("n_tokens") >= max(8, int(0.94 * cap)))
    share = F.avg(F.coalesce(cut, F.lit(False)).cast("int"))
    half = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_tokens DESC)")
    return generated.groupBy(*by).agg(F.round(share, 6).alias("truncated"), half.alias("median_tokens"), (share >= 0.2).alias("cap_binds"))
