"""Stupid-backoff scores of every document under the rest of the corpus.

S(w | context) = c(context w) / c(context) if that n-gram occurs in another document, else 0.4 * S(w | shorter context),
and c(w) / N without any context. Counts are those of the whole corpus without the document itself; a word that no other
document has counts as one occurrence. Contexts have up to order - 1 words, fewer at the beginning of a document.

The relations, for one or two orders at a time: each block of documents explodes into its distinct n-grams (hash, count).
These are dealt out by hash, so each slice of the count table has every block's counts of its n-grams (pre-aggregated in
the block, whatever a frequent n-gram has) and adds them up. The table is joined back to the exploded n-grams of each
block, and their logarithms are summed for each document. Rows are packed: a slice of a block is one row with its sorted
hashes (differences by byte planes, compressed) and counts. There are as many blocks and slices as the text needs for
neither to outgrow a worker, and as many tasks. The totals of the orders are written one after the other, so that the
count tables of two of them never lie on disk together. Documents are dealt out by a hash of the whole row. An n-gram
is a 64-bit hash; key 0 counts all words.

Defined cases: a null or blank text has no words, score 0 and a null mean; in a table with one document all
counts of others are 0, and each word counts as one in one; repeated rows are documents of their own; an empty table
gives no rows; a document is always within one block, so a very long one takes a worker some 200 times its words in
bytes. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import claim, documents, lean, remembers, ship_package, stash, utf8

BLOCK_BYTES, BACKOFF, ORDER = 8_000_000, 0.4, 3
KEPT_WORDS = 400_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word) | 1
        if len(word) < 64:
            self[word] = found
        return found


HASHES = WordHashes()
remembers("word hashes", HASHES.clear)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unplanes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").reshape(n)


def exploded(texts: list[bytes | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each place of all texts on end the hashes of the n-grams that end there, for n = 1 to order (0 where the text
    begins later), and words by text."""
    claim("word hashes")
    sizes, hashed = [], []
    for text in texts:
        words = (text or b"").split()
        sizes.append(len(words))
        hashed.append(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)))
    size = np.array(sizes, np.int64)
    words = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    grams = [words]
    for n in range(2, order + 1):
        longer = np.zeros(len(words), np.uint64)
        if len(words):
            mixed = ((grams[-1][:-1] * A) ^ (words[1:] * B + (words[1:] >> C))) * A
            longer[1:] = (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1)
            longer[place < n - 1] = 0
        grams.append(longer)
    return grams, size


def phases(order: int) -> list[tuple[int, ...]]:
    """The orders that are counted together: words and pairs first, then one at a time."""
    return [tuple(range(1, min(order, 2) + 1)), *[(n,) for n in range(3, order + 1)]]


def keys_of(grams: list[np.ndarray], orders: tuple[int, ...]) -> np.ndarray:
    every = np.concatenate([grams[n - 1] for n in orders])
    return every[every != 0]


def table(grams: list[np.ndarray], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, with key 0 for all words if single words are among the orders."""
    keys, n = np.unique(keys_of(grams, orders), return_counts=True)
    if 1 in orders:
        return np.concatenate([np.zeros(1, np.uint64), keys]), np.concatenate([[len(grams[0])], n])
    return keys, n


def cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    edges = np.array([(i << 64) // slices for i in range(slices)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def others(grams: list[np.ndarray], orders: tuple[int, ...], totals: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """By order, for each place: how often other documents have the n-gram that ends there. totals: of table()'s keys."""
    keys, at = np.unique(keys_of(grams, orders), return_inverse=True)
    totals = totals[1:] if 1 in orders else totals
    out, start = [], 0
    for n in orders:
        has = np.flatnonzero(grams[n - 1])
        found = at[start : start + len(has)]
        start += len(has)
        count = totals[found]
        more = count > 1  # all others occur nowhere else
        code = found[more] * (doc[-1] + 1 if len(doc) else 1) + doc[has[more]]
        _, which, own = np.unique(code, return_inverse=True, return_counts=True)
        left = np.zeros(len(has), np.int64)
        left[more] = count[more] - own[which]
        full = np.zeros(len(doc), np.int64)
        full[has] = left
        out.append(full)
    return out


def score(grams: list[np.ndarray], size: np.ndarray, totals: list[np.ndarray], backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """By document: the sum of log10 S, and how many words with a context backed off from their longest one."""
    doc = np.repeat(np.arange(len(size)), size)
    counts = [c for orders, t in zip(phases(len(grams)), totals, strict=True) for c in others(grams, orders, t, doc)]
    words = np.maximum(totals[0][0] - size, 1)[doc] if len(totals[0]) else np.ones(0)
    s = np.maximum(counts[0], 1) / words
    missed = np.zeros(len(doc), bool)
    for n in range(2, len(grams) + 1):
        has, count = grams[n - 1] != 0, counts[n - 1]
        context = np.concatenate(([0], counts[n - 2][:-1]))[: len(doc)]
        seen = count > 0
        s = np.where(seen, count / np.maximum(np.maximum(context, count), 1), np.where(has, backoff * s, s))
        missed = np.where(has, ~seen, missed)
    return np.bincount(doc, np.log10(s), len(size)).astype(float), np.bincount(doc, missed, len(size)).astype(np.int64)


SLICED = "block bigint, slice bigint, hashes binary, counts binary"
TOTALS = "phase int, block bigint, slice bigint, totals binary"
SCORES = "doc_id bigint, n_words bigint, n_backoff bigint, log10_score double, mean_log10 double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, backoff: float = BACKOFF) -> DataFrame:
    if order < 1:
        raise ValueError("order >= 1 is needed")
    ship_package(docs.sparkSession)
    text = docs[text_col].cast("string")
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = slices = max(1, -(-total // block_bytes))
    dealt = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")

    def explode(orders: tuple[int, ...]):
        def run(group: pa.Table) -> pa.Table:
            keys, n = table(exploded(utf8(group["text"].combine_chunks()), max(orders))[0], orders)
            at, block = cuts(keys, slices), group["block"][0].as_py()
            full = [i for i in range(slices) if at[i + 1] > at[i]]
            hashes = [planes(np.diff(keys[at[i] : at[i + 1]], prepend=np.uint64(0))) for i in full]
            counts = [planes(n[at[i] : at[i + 1]]) for i in full]
            return pa.table({"block": pa.array([block] * len(full), pa.int64()), "slice": pa.array(full, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary())})

        return run

    def add_up(phase: int):
        def run(group: pa.Table) -> pa.Table:
            parts = [np.cumsum(unplanes(x), dtype=np.uint64) for x in group["hashes"].to_pylist()]
            n = np.concatenate([unplanes(x) for x in group["counts"].to_pylist()]).astype(np.int64)
            every = np.concatenate(parts)
            placed = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], every[placed[1:]] != every[placed[:-1]])))
            sums = np.empty(len(every), np.int64)
            sums[placed] = np.repeat(np.add.reduceat(n[placed], first), np.diff(np.append(first, len(every))))
            ends = np.cumsum([len(p) for p in parts])
            totals = [planes(x) for x in np.split(sums, ends[:-1])]
            return pa.table({"phase": pa.array([phase] * len(totals), pa.int32()), "block": group["block"], "slice": group["slice"], "totals": pa.array(totals, pa.binary())})

        return run

    def summed(group: pa.Table, found: pa.Table) -> pa.Table:
        grams, size = exploded(utf8(group["text"].combine_chunks()), order)
        rows = sorted(zip(found["phase"].to_pylist(), found["slice"].to_pylist(), found["totals"].to_pylist(), strict=True), key=lambda r: r[:2])
        totals = [np.concatenate([*(unplanes(x) for p, _, x in rows if p == phase), np.zeros(0, np.uint64)]).astype(np.int64) for phase in range(len(phases(order)))]
        logs, backed = score(grams, size, totals, backoff)
        means = [round(v / k, 6) if k else None for v, k in zip(logs.tolist(), size.tolist(), strict=True)]
        return pa.table({"doc_id": group["doc_id"], "n_words": pa.array(size), "n_backoff": pa.array(backed), "log10_score": pa.array(np.round(logs, 6)), "mean_log10": pa.array(means, pa.float64())})

    def totals_of(phase: int, orders: tuple[int, ...]) -> DataFrame:
        tables = dealt.groupBy("block").applyInArrow(lean(explode(orders)), SLICED).repartition(slices, "slice")
        return stash(tables.groupBy("slice").applyInArrow(lean(add_up(phase)), TOTALS), "ngram_totals")

    counted = reduce(DataFrame.unionByName, [totals_of(*p) for p in enumerate(phases(order))]).repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(lean(summed), SCORES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def oracle(order: int = ORDER) -> str:
    """Counts by plain grouping; n-grams are lists of words."""
    count = lambda n: f"g{n} AS (SELECT doc, i, w[i - {n - 1} : i] AS g FROM p WHERE i >= {n}), t{n} AS (SELECT g, count(*) AS n FROM g{n} GROUP BY g), o{n} AS (SELECT doc, g, count(*) AS n FROM g{n} GROUP BY ALL), c{n} AS (SELECT doc, i, t{n}.n - o{n}.n AS c FROM g{n} JOIN t{n} USING (g) JOIN o{n} USING (doc, g))"
    step = lambda n: f"s{n} AS (SELECT s.doc, s.i, CASE WHEN a.c > 0 THEN a.c / greatest(b.c, a.c)::DOUBLE WHEN s.i >= {n} THEN {BACKOFF}::DOUBLE * s ELSE s END AS s, CASE WHEN s.i >= {n} THEN a.c = 0 ELSE missed END AS missed FROM s{n - 1} s LEFT JOIN c{n} a ON a.doc = s.doc AND a.i = s.i LEFT JOIN c{n - 1} b ON b.doc = s.doc AND b.i = s.i - 1)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x != '') AS w FROM documents),
p AS (SELECT doc, w, unnest(generate_series(1, len(w))) AS i FROM d), total AS (SELECT sum(len(w)) AS total FROM d), {", ".join(count(n) for n in range(1, order + 1))},
s1 AS (SELECT doc, i, greatest(c, 1) / greatest(total - len(w), 1)::DOUBLE AS s, false AS missed FROM c1 JOIN d USING (doc), total), {", ".join(step(n) for n in range(2, order + 1))},
e AS (SELECT doc, sum(log10(s)) AS l, count(*) FILTER (WHERE missed) AS b FROM s{order} GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backoff, round(coalesce(l, 0.0), 6) AS log10_score, CASE WHEN len(w) > 0 THEN round(l / len(w), 6) END AS mean_log10 FROM d LEFT JOIN e USING (doc)"""


ORACLE = oracle()
