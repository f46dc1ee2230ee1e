"""Line deduplication by a deletion-neighbourhood join, with DataFrame operations only.

A line occurrence goes if an earlier one (smaller doc_id, then smaller line number) of the whole table has
an edit distance of at most 1 from it, identical lines included. Two lines of which the shorter has m
characters are within one edit exactly if they are equal, or become equal when one character is deleted
at the same place of both (substitution), or when one character of the longer is deleted (insertion).

1. Distinct lines: one row of numbers each, with the earliest occurrence and four hashes (aggregated by hash,
   partially before the shuffle).
2. A lossless filter: the single edit lies in one half of the line, so the other half is equal. The four hashes
   are of each half, for the line as the shorter and as the longer one; who shares none has no partner. Lines
   of LONG characters or more that are left pass the same filter over smaller blocks, so that the variants of
   one line take about length ** 1.5 steps.
3. The rest emit all deletion variants inside the blocks that matched, as hashed keys. Equal variants are
   met by aggregation, not by pairs: all lines of a substitution key are within one edit of each other, so
   the earliest of them stands for all; an insertion key has the undeleted line on one side and the earliest
   longer line on the other. A key that many lines share is one partial row a task.
4. The partner chosen is verified by edit distance on the lines themselves.

Defined cases: a null text has no lines; lines of fewer than min_chars characters (blank ones included)
take no part and stay; with exact_chars, exact copies of shorter lines go as well if they have that many characters
and are not blank, but they have no near copies (op8 asks for all of one character or more); of repeated rows (one doc_id,
equal lines) all occurrences at the earliest place stay; a null doc_id comes before every other. Line ids are two 64-bit hashes of the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import documents, partitions, stash

MIN_CHARS = 20
LONG = 100
NOT_BLANK = r"[^\x20\x09-\x0D]"


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """doc_id, version (hash of the text: rows may share a doc_id), line_no, line and its place in the order of occurrences.

    The place is one decimal, because Spark aggregates numbers by hash but structs by sorting.
    """
    frame = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    split = frame.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.expr("coalesce(cast(doc_id AS decimal(19, 0)), -9223372036854775809BD) * 10000000000BD + line_no").alias("place")
    part = F.length("line") >= min_chars
    if exact_chars is not None:
        part |= (F.length("line") >= exact_chars) & F.col("line").rlike(NOT_BLANK)
    return split.where(part).select("*", place, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))


#: Key of the half that stays outside, by kind: bit 0 is the half with the edit, bit 1 is set for the longer line.
HALVES = [
    f"xxhash64({m}, {half}, {'substring(line, ' + m + ' div 2 + 1 + length(line) - ' + m + ')' if half == 0 else 'substring(line, 1, ' + m + ' div 2)'})"
    for m in ("length(line)", "(length(line) - 1)") for half in (0, 1)
]


def distinct_lines(found: DataFrame, least: int | None = None) -> DataFrame:
    """Lines of fewer than least characters have null keys."""
    key = lambda h: F.expr(h) if least is None else F.when(F.length("line") >= least, F.expr(h))
    keyed = found.select("a", "b", "place", *[key(h).alias(f"k{i}") for i, h in enumerate(HALVES)])
    ks = [f"k{i}" for i in range(len(HALVES))]
    return stash(keyed.groupBy("a", "b").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in ks]), "distinct_lines")


def only_shared(keyed: DataFrame) -> DataFrame:
    """Rows whose key another row has as well; a line has a key once, a null key meets none."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("key")
    return keyed.join(shared.hint("merge"), "key", "left_semi")


def candidates(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """a, b, first, line, mask of the kinds of halves it shares, of lines that can have a partner."""
    keyed = distinct.select("a", "b", "first", F.posexplode(F.array(*[f"k{i}" for i in range(len(HALVES))])).alias("kind", "key"))
    hits = only_shared(keyed).groupBy("a", "b").agg(F.min("first").alias("first"), F.expr("bit_or(shiftleft(1, kind))").alias("mask"))
    at = hits.select(F.col("a").alias("ha"), F.col("b").alias("hb"), "first", "mask")
    met = found.select("place", "a", "b", "line").join(at.hint("merge"), F.expr("place = first AND a = ha AND b = hb"))
    return stash(met.groupBy("a", "b").agg(F.first("first").alias("first"), F.first("mask").alias("mask"), F.first("line").alias("line")), "line_candidates")


def blocks(texts: DataFrame) -> DataFrame:
    """a, b, first, line, m, low, high: places low to high - 1 of the shorter line can hold the edit."""
    kinds = F.expr("filter(sequence(0, 3), k -> (shiftright(mask, k) & 1) = 1)")
    halves = texts.select("a", "b", "first", "line", F.explode(kinds).alias("kind")).withColumn("m", F.expr("length(line) - shiftright(kind, 1)"))
    halves = halves.selectExpr("a", "b", "first", "line", "m", "IF(kind % 2 = 0, 0, m div 2) AS low", "IF(kind % 2 = 0, m div 2, m) AS high")
    short, long = halves.where(F.col("m") < LONG), halves.where(F.col("m") >= LONG)
    count = "cast(ceil(sqrt(m) / 2) AS int)"
    parts = F.expr(f"transform(sequence(0, {count} - 1), i -> named_struct('low', cast(low + i * (high - low) div {count} AS int), 'high', cast(low + (i + 1) * (high - low) div {count} AS int)))")
    cut = long.select("a", "b", "first", "m", "line", F.explode(parts).alias("p")).select("a", "b", "first", "m", "p.*", F.expr("xxhash64(m, p.low, substring(line, 1, p.low), substring(line, p.high + 1 + length(line) - m))").alias("key"))
    left = only_shared(cut).where("high > low").drop("key", "first")
    return short.unionByName(left.join(texts.where(F.length("line") >= LONG).select("a", "b", "first", "line").hint("merge"), ["a", "b"]))


def variants(line: str = "line") -> str:
    """(key, side) of each deletion from low to high. Sides: 0 substitution, 1 the line itself, 2 longer by one."""
    without = f"concat(substring({line}, 1, p), substring({line}, p + 2))"
    deleted = f"""transform(sequence(low, high + length({line}) - m - 1), p -> IF(length({line}) = m,
        named_struct('key', xxhash64('substituted', m, p, {without}), 'side', 0),
        named_struct('key', xxhash64('inserted', m, {without}), 'side', 2)))"""
    return f"""IF(length({line}) = m, concat({deleted}, array(named_struct('key', xxhash64('inserted', m, {line}), 'side', 1))), {deleted})"""


def near_firsts(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """For each distinct line that has one: the earliest occurrence of a line within one edit."""
    texts = candidates(found, distinct)
    made = (
        blocks(texts).select("a", "b", F.struct("first", "a", "b").alias("me"), F.explode(F.expr(variants())).alias("v"))
        .select("a", "b", "me", "v.*").distinct()
    )
    met = made.groupBy("key").agg(
        F.min(F.when(F.col("side") < 2, F.col("me"))).alias("same"), F.min(F.when(F.col("side") == 2, F.col("me"))).alias("longer"), F.count(F.lit(1)).alias("n"),
    ).where("n > 1").drop("n")
    best = (
        made.join(met.hint("merge"), "key")
        .select("a", "b", F.when(F.col("side") == 1, F.col("longer")).otherwise(F.col("same")).alias("partner"))
        .where("partner IS NOT NULL AND NOT (partner.a = a AND partner.b = b)").groupBy("a", "b").agg(F.min("partner").alias("partner"))
    )
    mine, other = texts.select("a", "b", "line"), texts.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("line").alias("other"))
    return (
        best.select("a", "b", F.col("partner.first").alias("near"), F.col("partner.a").alias("oa"), F.col("partner.b").alias("ob"))
        .join(mine.hint("merge"), ["a", "b"]).join(other.hint("merge"), ["oa", "ob"])
        .where(F.levenshtein("line", "other", 1) >= 0).select("a", "b", "near")
    )


def hot_lines(distinct: DataFrame) -> DataFrame:
    """Lines that hold more than a quarter of a task's fair share of all lines, four a task at most, and into how many
    parts of that size each is cut: eight a task altogether at most."""
    share = 4 * partitions(distinct.sparkSession)
    total = distinct.agg(F.sum("n")).first()[0] or 0
    return distinct.where(F.col("n") * share > total).select("a", "b", F.ceil(F.col("n") * share / max(total, 1)).cast("int").alias("parts"))


def judged_occurrences(occurrences: DataFrame, distinct: DataFrame, near: DataFrame) -> DataFrame:
    """Occurrences of lines that have a copy or an earlier near one, with first and stays (the earliest of both).

    The occurrences of a hot line are dealt to several tasks, each of which gets its verdict.
    """
    hot = F.broadcast(hot_lines(distinct))
    verdicts = distinct.select("a", "b", "first", "n").join(near.hint("merge"), ["a", "b"], "left").where("n > 1 OR near < first")
    parts = F.coalesce("parts", F.lit(1))
    salted = verdicts.join(hot, ["a", "b"], "left").select("a", "b", "first", F.least("first", "near").alias("stays"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    dealt = occurrences.join(hot, ["a", "b"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "line_no"), parts).cast("int")).drop("parts")
    return dealt.join(salted.hint("merge"), ["a", "b", "salt"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """doc_id, text: the lines that stay, joined again; n_lines, n_exact, n_near: how many lines went as copies and as near copies."""
    found = lines(docs, id_col, text_col, min_chars, exact_chars)
    distinct = distinct_lines(found, None if exact_chars is None else min_chars)
    occurrences = found.select("doc_id", "version", "line_no", "place", "a", "b")
    dropped = (
        judged_occurrences(occurrences, distinct, near_firsts(found, distinct)).where("place > stays")
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"))
        .agg(F.collect_set("line_no").alias("gone"), F.collect_set(F.when(F.col("place") > F.col("first"), F.col("line_no"))).alias("exact"))
    )
    whole = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).withColumn("version", F.xxhash64("text"))
    whole = whole.join(dropped.hint("merge"), F.expr("doc_id <=> gone_id AND version = gone_version"), "left").withColumn("parts", F.split("text", "\n"))
    kept = F.expr(r"array_join(transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\n')")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return whole.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        zero(F.when(F.col("parts").isNotNull(), F.size("parts"))).alias("n_lines"),
        zero(F.when(F.col("gone").isNotNull(), F.size("exact"))).alias("n_exact"),
        zero(F.when(F.col("gone").isNotNull(), F.size("gone") - F.size("exact"))).alias("n_near"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Brute force over distinct lines: each of MIN_CHARS characters or more with every other that is at most one character
#: longer or shorter; shorter ones, if they are not blank, have exact copies only.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), d AS (
  SELECT line, length(line) AS n, min(doc_id * 1000000 + line_no) AS at FROM l WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), near AS (
  SELECT a.line, min(b.at) AS near FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND a.line != b.line
  WHERE a.n >= 20 AND b.n >= 20 AND (substring(a.line, 1, (least(a.n, b.n) - 1) // 2) = substring(b.line, 1, (least(a.n, b.n) - 1) // 2)
      OR right(a.line, (least(a.n, b.n) - 1) // 2) = right(b.line, (least(a.n, b.n) - 1) // 2))
    AND levenshtein(a.line, b.line) <= 1 GROUP BY a.line
), v AS (
  SELECT l.doc_id, l.line_no, l.line, l.doc_id * 1000000 + l.line_no > d.at AS exact, coalesce(l.doc_id * 1000000 + l.line_no > least(d.at, near.near), l.doc_id * 1000000 + l.line_no > d.at, false) AS gone
  FROM l LEFT JOIN d USING (line) LEFT JOIN near USING (line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone AND exact) AS n_exact, count(*) FILTER (WHERE gone AND NOT coalesce(exact, false)) AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
