"""Model calls under a cap: prompts are answered in slices, and each slice's answers and costs are committed together before
the next one is asked.

Examples are called in the order of example_id. A slice is as many examples as cannot pass what is left of the cap, by an
upper bound of what each may cost, or one example where not even one surely fits. So with true bounds the run stops behind
the very example whose cost passes the cap, as one that asks example by example would, and yet most examples are asked in
few, wide slices. A run that is repeated after a crash or a stop goes on behind the last slice that was committed.

The ledger is a Committed table for each run (a configuration and a domain) under one folder, and the cap holds for all of
them together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from grainfold.operators import experiments
from grainfold.session import stash
from grainfold.sources import tables
from grainfold.sources.committed import Committed

#: The columns of a ledger; what a call without a limit of its own is taken to answer at most, in tokens.
COUNTS = [f"{leg}_{c}" for leg in ("gen", "judge") for c in ("calls", "in_tokens", "out_tokens")]
SPENT = t.StructType(
    [t.StructField("run", t.StringType()), t.StructField("slice", t.LongType()), t.StructField("seq", t.LongType()), t.StructField("upto", t.LongType())]
    + [t.StructField("folder", t.StringType())] + [t.StructField(c, t.LongType()) for c in COUNTS] + [t.StructField("usd", t.DoubleType())]
)
ANSWER_TOKENS = 2048


class CapPassed(RuntimeError):
    """The calls so far cost more than the cap. They are all in the ledger."""


def usd(in_tokens: Column, out_tokens: Column, price: tuple[float, float]) -> Column:
    return (F.coalesce(in_tokens, F.lit(0)) * price[0] + F.coalesce(out_tokens, F.lit(0)) * price[1]) / 1e6


@dataclass
class Budget:
    """path: where the ledger is kept. prices: (model, US dollars a million tokens in, and out). slice_rows: the most examples
    that are asked between two commits; their numbers and bounds are what the driver holds."""

    spark: SparkSession
    path: str
    cap: float = experiments.CAP_USD
    prices: list[tuple[str, float, float]] = field(default_factory=lambda: list(experiments.PRICES))
    slice_rows: int = 4096

    def price(self, model: str | None) -> tuple[float, float]:
        """Nothing for a model that charges nothing; an unknown one costs as much as the dearest one, for each side."""
        if model is None:
            return 0.0, 0.0
        known = {m: (a, b) for m, a, b in self.prices}
        return known.get(model) or (max(a for a, _ in known.values()), max(b for _, b in known.values()))

    @property
    def spent(self) -> Committed:
        return Committed(self.spark, f"{self.path}/spent", SPENT)

    def total(self) -> float:
        """US dollars of all slices of all runs."""
        return self.spent.read().agg(F.coalesce(F.round(F.sum("usd"), 6), F.lit(0.0))).first()[0]

    def bound(self, generator: object, judge: object) -> Column:
        """The most an example may cost: a token has a byte at least, a judge sees the sources and the answer, and asks again."""
        asked, gen, judged = F.octet_length("prompt"), self.price(getattr(generator, "charged", None)), self.price(getattr(judge, "charged", None))
        tries = getattr(judge, "max_retries", 0) + 1
        most = F.lit(ANSWER_TOKENS)
        return usd(asked, most, gen) + tries * usd(8 * asked + 4 * most + 4096, most, judged)

    def run(self, name: str, prompts: DataFrame, answer: Callable[[DataFrame], DataFrame], generator: object, judge: object = None, bound: Column | None = None) -> DataFrame:
        """All answered rows of run `name`: prompts (example_id, prompt, ...) with what answer() adds, and row_no, slice, gen_usd
        and judge_usd. Raises CapPassed behind the slice that passes the cap, or at once if it is passed already."""
        calls = stash(tables.numbered(prompts, "example_id").withColumn("__bound", self.bound(generator, judge) if bound is None else bound), "prompts")
        n = calls.count()
        while True:
            mine = self.slices(name)
            start, total = max((r["upto"] for r in mine), default=0), self.total()
            if total > self.cap:
                raise CapPassed(f"{total:.6f} US dollars are above the cap of {self.cap:.2f}; ledger: {self.path}")
            if start >= n and mine:
                return self.answers(name)
            ahead = calls.where(F.col("row_no").between(start, start + self.slice_rows - 1)).select("row_no", "__bound")
            left, end = self.cap - total, start
            for _, most in sorted(map(tuple, ahead.collect())):  # slice_rows numbers at most
                if end > start and most > left:
                    break
                left, end = left - most, end + 1
            rows = calls.where(F.col("row_no").between(start, end - 1)).drop("__bound")
            self.commit(name, len(mine), end, answer(rows), self.price(getattr(generator, "charged", None)), self.price(getattr(judge, "charged", None)))

    def slices(self, name: str) -> list:
        """The slices of a run that are committed, in order."""
        return self.spent.read().where(F.col("run") == name).orderBy("slice").collect()

    def answers(self, name: str) -> DataFrame:
        """What run `name` has committed."""
        return self.spark.read.parquet(*[f"{self.path}/answers/{r['folder']}" for r in self.slices(name)])

    def commit(self, name: str, number: int, upto: int, made: DataFrame, gen: tuple[float, float], judged: tuple[float, float]) -> None:
        folder = uuid.uuid4().hex
        costs = {"gen_usd": F.round(usd(F.col("in_tokens"), F.col("out_tokens"), gen), 6), "judge_usd": F.round(usd(F.col("judge_in_tokens"), F.col("judge_out_tokens"), judged), 6)}
        made.withColumns(costs | {"run": F.lit(name), "slice": F.lit(number).cast("bigint")}).write.parquet(f"{self.path}/answers/{folder}")
        rows = with_counts(self.spark.read.parquet(f"{self.path}/answers/{folder}"), any(gen), any(judged))
        spent = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.coalesce(F.round(F.sum(F.col("gen_usd") + F.col("judge_usd")), 6), F.lit(0.0)).alias("usd"))
        known = {"run": name, "slice": number, "seq": len(self.spent.manifests()), "upto": upto, "folder": folder}
        self.spent.append(spent.select(*[F.lit(v).alias(c) for c, v in known.items()], "*"), ["run", "slice"])

    def snapshot(self, answers: DataFrame) -> DataFrame:
        """Rows of answers() with cost: what all runs had cost when the row's example was done."""
        earlier = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in (*COUNTS, "usd")]
        before = self.spent.read().select("run", "slice", *sums)
        within = Window.partitionBy("run", "slice").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
        charged = [self.spent.read().agg(F.coalesce(F.sum(f"{leg}_calls"), F.lit(0)) > 0).first()[0] for leg in ("gen", "judge")]
        rows = with_counts(answers, *charged).withColumn("__own", F.col("gen_usd") + F.col("judge_usd")).join(before, ["run", "slice"])
        cost = [F.round(F.col("__usd") + F.sum("__own").over(within), 6).alias("total_usd"), *[(F.col(f"__{c}") + F.sum(c).over(within)).alias(c) for c in COUNTS]]
        return rows.withColumn("cost", F.struct(*cost)).drop("__own", *COUNTS, *[f"__{c}" for c in (*COUNTS, "usd")])


def with_counts(rows: DataFrame, gen: bool, judged: bool) -> DataFrame:
    """COUNTS of each row; a leg that is not charged counts nothing."""
    count = lambda on, c: F.when(F.lit(on), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumns({
        "gen_calls": count(gen, F.lit(1)), "gen_in_tokens": count(gen, F.col("in_tokens")), "gen_out_tokens": count(gen, F.col("out_tokens")),
        "judge_calls": count(judged, F.lit(1)), "judge_in_tokens": count(judged, F.col("judge_in_tokens")), "judge_out_tokens": count(judged, F.col("judge_out_tokens")),
    })
