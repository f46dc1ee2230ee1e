"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

For each text: the share of word characters inside word n-grams that occur twice or more (each length on
its own), inside lines that occur twice or more, and inside the one short n-gram that covers most of the text
(no short one that occurs once counts; where its occurrences overlap, characters count once). Words are `[^\x20\x09-\x0D]+`. Windows of n words
are compared by a 64-bit polynomial rolling hash, each length made from the next shorter one, over
64-bit word hashes; texts are never compared with each other, so a clash needs two windows of one text.

Defined cases: a null or blank text has no words and fails the base rules; a text shorter than a window
has none; repeated rows each get their row. Memory is one Arrow batch plus a few arrays of its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grainfold.llm.common import documents, map_texts, utf8

#: Largest share of word characters inside duplicated n-grams, by n, inside one short n-gram, and inside duplicated lines.
#: They lie under the base rule's 20 % of words in repeated 5-grams, so that they decide where it does not.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
LINE_LIMIT = 0.20
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, line_share double, ngram_share double"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at a marked place."""
    steps = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1], dtype=np.int32) > 0


def largest(keys: np.ndarray, n: int, before: np.ndarray) -> int:
    """The most characters that one n-gram covers which occurs twice or more; before: characters before each word."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    start = order.copy()
    start[1:][same] = np.maximum(order[1:], order[:-1] + n)[same]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    sums = np.add.reduceat(before[order + n] - before[start], first)
    return int(sums[np.diff(np.append(first, len(keys))) > 1].max())


def measure(text: bytes, limits: dict[int, float] = NGRAM_LIMITS, top_limits: dict[int, float] = TOP_LIMITS) -> tuple[int, int, int, int, int, float, dict[int, float], dict[int, float]]:
    """(words, word characters, symbols, duplicate lines, words in repeated 5-grams, line share, n-gram shares, shares of one n-gram)."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    n = len(words)
    symbols = int(SYMBOL[raw].sum())
    if not n:
        return 0, 0, symbols, 0, 0, 0.0, dict.fromkeys(limits, 0.0), dict.fromkeys(top_limits, 0.0)
    inside = np.concatenate(([False], ~SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[edge[1::2]] - points[edge[::2]]
    total = int(chars.sum())

    lines: dict[bytes, list[int]] = {}
    for line in text.split(b"\n"):
        if k := len(line.split()):
            seen = lines.setdefault(line, [0, k])
            seen[0] += 1
    duplicates = sum(c for c, _ in lines.values()) - len(lines)
    line_chars = 0
    if duplicates:
        line_chars = sum(c * sum(len(w.decode("utf-8", "replace")) for w in line.split()) for line, (c, _) in lines.items() if c > 1)

    hashes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    rolled, width, shares, top, repeats = hashes, 1, {}, {}, 0
    before = np.concatenate(([0], np.cumsum(chars)))
    for size in sorted({5, *limits, *top_limits}):
        if size > n:
            shares[size] = top[size] = 0.0
            continue
        while width < size:
            rolled = rolled[:-1] * BASE + hashes[width:]
            width += 1
        if size in top_limits:
            top[size] = largest(rolled, size, before) / total
        if size != 5 and size not in limits:
            continue
        twice = repeated(rolled)
        mark = covered(twice, size, n) if twice.any() else np.zeros(n, bool)
        shares[size] = float(chars[mark].sum() / total)
        if size == 5:
            repeats = int(mark.sum())
    return n, total, symbols, duplicates, repeats, line_chars / total, {k: shares[k] for k in limits}, {k: top[k] for k in top_limits}


def verdicts(limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, top_limits: dict[int, float] = TOP_LIMITS):
    def work(batch: pa.RecordBatch):
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
            n, total, symbols, lines, repeats, line_share, shares, top = measure(text or b"", limits, top_limits)
            failed = n < 10 or 100 * repeats > 20 * n
            kept = not failed and line_share <= line_limit and all(shares[k] <= v for k, v in limits.items()) and all(top[k] <= v for k, v in top_limits.items())
            rows.append((doc, n, total, symbols, lines, repeats, failed, kept, line_share, max(shares.values(), default=0.0)))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return work


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, top_limits: dict[int, float] = TOP_LIMITS) -> DataFrame:
    return map_texts(docs, id_col, text_col, lambda: verdicts(limits, line_limit, top_limits), SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def oracle() -> str:
    """Windows by their digests, each length on its own."""
    blank, blanks = r"[\x20\x09-\x0D]+", lambda x: rf"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda x: x != '')"
    sizes = sorted({5, *NGRAM_LIMITS, *TOP_LIMITS})
    values = lambda limits: ", ".join(f"({n}, {v}::DOUBLE)" for n, v in limits.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {blanks("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols FROM d),
l AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_replace(line, '{blank}', '', 'g') != '' GROUP BY ALL),
lines AS (SELECT doc_id, sum(c - 1) AS dup, sum(CASE WHEN c > 1 THEN c * length(regexp_replace(line, '{blank}', '', 'g')) ELSE 0 END) AS chars FROM l GROUP BY doc_id),
p AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT unnest({sizes}) AS size) WHERE len(w) >= size),
g AS (SELECT doc_id, size, i, md5(array_to_string(w[i : i + size - 1], ' ')) AS g FROM p), r AS (SELECT doc_id, size, g, list(i) AS places FROM g GROUP BY ALL HAVING count(*) > 1),
a AS (SELECT DISTINCT doc_id, size, g, i + k AS i FROM (SELECT doc_id, size, g, unnest(places) AS i FROM r), LATERAL (SELECT unnest(generate_series(0, size - 1)) AS k)),
c AS (SELECT a.*, length(w[i]) AS chars FROM a JOIN d USING (doc_id)), whole AS (SELECT doc_id, size, sum(chars) AS chars, count(*) AS words FROM (SELECT DISTINCT doc_id, size, i, chars FROM c) GROUP BY ALL),
one AS (SELECT doc_id, size, max(chars) AS chars FROM (SELECT doc_id, size, g, sum(chars) AS chars FROM c GROUP BY ALL) GROUP BY ALL),
x AS (SELECT doc_id, max(whole.chars / n.chars) FILTER (WHERE limits.n IS NOT NULL) AS share, bool_or(whole.chars / n.chars > lim) AS over, max(words) FILTER (WHERE size = 5) AS repeats FROM whole JOIN n USING (doc_id) LEFT JOIN (VALUES {values(NGRAM_LIMITS)}) AS limits(n, lim) ON size = limits.n GROUP BY doc_id),
y AS (SELECT doc_id, bool_or(one.chars / n.chars > lim) AS over FROM one JOIN n USING (doc_id) JOIN (VALUES {values(TOP_LIMITS)}) AS limits(n, lim) ON size = limits.n GROUP BY doc_id),
z AS (SELECT n.*, coalesce(dup, 0) AS dup, coalesce(repeats, 0) AS repeats, coalesce(lines.chars / nullif(n.chars, 0), 0)::DOUBLE AS line_share, coalesce(share, 0)::DOUBLE AS ngram_share, coalesce(x.over, false) OR coalesce(y.over, false) AS over FROM n LEFT JOIN lines USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)),
f AS (SELECT *, n < 10 OR 100 * repeats > 20 * n AS failed FROM z)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, repeats::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND NOT over AND line_share <= {LINE_LIMIT}::DOUBLE AS kept, line_share, ngram_share FROM f"""


ORACLE = oracle()
