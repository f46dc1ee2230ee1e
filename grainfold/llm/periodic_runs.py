"""Periodic runs of words, by bit-parallel comparison of a text with itself at every lag that can hold one.

The words of a text are numbered, and bit b of all numbers is one big integer, a plane. A plane XOR the plane shifted by
a lag is 1 where words that far apart differ in that bit; the OR over planes is 1 where the words differ. A run of
period q is a long stretch of zeros at lag q. Shifting by 1, 2, 4, ... and AND-ing leaves the places at which a
stretch of the least length starts; most lags have none after two planes, the others get all planes.

Lags are sieved first, so that the work grows with n log n and not with the square of n: a run of `times` periods q
has `times` equal words at multiples of q in a row. Two periods of one stretch of at least their sum have their greatest
common divisor as a period; so what is found again at a greater lag, with the same ends, has the smaller period, and
multiples of q that lie in one known run of a smaller period belong to no run of smallest period q. Lags are sieved
from 2 ** j to 2 ** (j + 1) together, because a multiple of a lag is always in a later range.

Defined cases: a null text has no words, no runs and an empty collapsed text; a text is one row's work, whatever its
length; rows that repeat are handled one by one; an empty table gives no rows; a null doc_id stays null.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import documents, map_texts

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
#: Places the sieve looks at together, and rows returned together.
SIEVE, ROWS = 1 << 20, 256
RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def planes_of(ids: np.ndarray) -> list[int]:
    """Plane b: the integer whose bit i is bit b of ids[i]."""
    n = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(n)]


def lags(padded: np.ndarray, n: int, low: int, times: int, reach: np.ndarray) -> list[int]:
    """Lags q from low to 2 * low that have `times` equal words at multiples of q in a row, not all inside one known run.

    padded: the ids of n words, then as many that equal nothing. reach[i]: where the known runs that start up to i end.
    """
    out, wide = [], (n - 1) // low + 1
    last, step = min(2 * low, n // times + 1), max(1, SIEVE // wide)
    for first in range(low, last, step):
        q = np.arange(first, min(first + step, last))
        at = q[:, None] * np.arange(wide)
        seen = padded[at]
        same = seen[:, 1:] == seen[:, :-1]
        width = same.shape[1] - times + 2
        row = same[:, :width].copy()
        for k in range(1, times - 1):
            row &= same[:, k : width + k]
        if row.any():
            row &= reach[np.minimum(at[:, :width], n - 1)] <= at[:, times - 1 :]
            out += q[row.any(axis=1)].tolist()
    return out


def stretches(match: int, need: int) -> int:
    """The places at which `need` ones in a row start."""
    have = 1
    while have < need and match:
        step = min(have, need - have)
        match &= match >> step
        have += step
    return match


def ones(bits: int) -> np.ndarray:
    """(first, last + 1) of each stretch of ones."""
    row = np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.flatnonzero(np.diff(np.concatenate(([0], row, [0])).astype(np.int8))).reshape(-1, 2)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period. times: 3 at least."""
    n, found, low = len(ids), {}, 1
    if n < max(least, times):
        return []
    planes, padded, reach = planes_of(ids), np.concatenate((ids, np.arange(-1, -n - 1, -1))), np.zeros(n, np.int64)
    while low * times <= n:
        before = len(found)
        for q in lags(padded, n, low, times, reach):
            need = max(least, times * q) - q
            whole, differ, starts = (1 << n - q) - 1, 0, 0
            for some in (planes[:2], planes[2:]):
                for plane in some:
                    differ |= plane ^ plane >> q
                starts = stretches(whole & ~differ, need)
                if not starts:
                    break
            if starts:
                for a, b in ones(starts).tolist():
                    found.setdefault((a, b - a + need - 1 + q), q)
        if len(found) > before:
            for start, length in found:
                reach[start] = max(reach[start], start + length)
            np.maximum.accumulate(reach, out=reach)
        low *= 2
    return sorted((start, length, q) for (start, length), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those of a run behind its first period."""
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edges[start + q] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the text without repeated periods.

    prepare(doc_id, words) may give other words instead of a text's own.
    """

    def make():
        def work(batch):
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                n, runs, texts = [], [], []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    words = (text.as_py() or "").encode().split()  # at 0x20 and 0x09 to 0x0D, and at nothing else
                    if prepare:
                        words = prepare(doc_id, words)
                    found = runs_of(numbered(words))
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(collapse(words, found).decode())
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        return work

    return map_texts(docs, id_col, text_col, make, RUNS)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: a tenth of the documents, by the checksum of doc_id, are made to repeat; a null doc_id is not."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periodic_runs(documents(spark, sf_dir), prepare=looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    made = made.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return made.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
