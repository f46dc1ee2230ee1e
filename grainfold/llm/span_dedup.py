"""Removal of byte spans that an earlier document has, by suffix arrays of shards.

A byte goes if a window of `width` bytes that covers it also starts in a document with a smaller doc_id.

1. Anchors. In each window the 20-byte string with the smallest hash is its anchor; equal windows have equal
   anchors at equal places. A run of windows with one anchor is a context: the bytes of those windows.
   Blocks of documents explode into their distinct anchors, dealt out by hash; an anchor of a single document
   ends there, so that only contexts that can match travel on.
2. Shards. Contexts are dealt out by their anchor's hash, each distinct one of a block once with its smallest
   doc_id. A shard's contexts on end are one text; its suffix array is induced, common prefixes are computed
   in text order, and each group of windows with `width` equal bytes gets its smallest doc_id.
   Anchors of very many documents are split: their windows are dealt out one by one, by the hash of the whole
   window, so that only equal windows meet. A shard works in pieces of bounded size between anchors.
3. The blocks get back the smallest doc_id of each window and mark what goes.

Rows between the steps are packed, a slice of a block each; blocks and slices grow in number with the text.
Documents are dealt out by a hash of the whole row.

Defined cases: a null text counts as empty; rows with one doc_id are one document to each other: neither
removes bytes of the other; a null doc_id comes after every other; texts shorter than the window stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import claim, documents, lean, ship_package, stash, utf8
from grainfold.llm.lm_scores import cuts, planes, unplanes
from grainfold.llm.quality_rules import covered
from grainfold.llm.suffix_array import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 50, 20
BLOCK_BYTES, PIECE_BYTES, HOT, CONTEXTS = 8_000_000, 1_000_000, 2_000, 50_000
LAST = np.iinfo(np.int64).max
M1, M2, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64((1 << 28) - 1)


class Block:
    """The documents of a block on end, and the runs of windows with one anchor: from, to (window starts), hash."""

    def __init__(self, group: pa.Table, width: int, gram: int):
        texts = [t or b"" for t in utf8(group["text"].combine_chunks())]
        ids = [LAST if i is None else i for i in group["doc_id"].to_pylist()]
        self.given = group["doc_id"]
        self.text, self.ids = b"".join(texts), np.array(ids, np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        claim("")
        raw = np.frombuffer(self.text, np.uint8)
        first = (self.ends - self.sizes)[self.sizes >= width]
        last = self.ends[self.sizes >= width] - width  # first and last window of the documents that have any
        self.start, self.stop, self.hash, self.bytes_hash = runs_of_windows(raw, first, last, width, gram)

    def docs(self) -> np.ndarray:
        return np.searchsorted(self.ends, self.start, "right")


def rolled(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, by doubling."""
    h, have, power = (raw.astype(np.uint64) + np.uint64(1)) * M2, 1, M1
    one = h
    with np.errstate(over="ignore"):
        for bit in bin(size)[3:]:
            h = h[:-have] * power + h[have:]
            h ^= h >> np.uint64(32)
            power = power * M2 + np.uint64(2)
            have *= 2
            if bit == "1":
                h = h[:-1] * power + one[have:]
                h ^= h >> np.uint64(32)
                power = power * M2 + np.uint64(2)
                have += 1
    return h


def runs_of_windows(raw: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, gram: int, chunk: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor inside the documents (windows first to last): from, to, hash of the anchor, hash of
    the run's bytes. Chunk by chunk, so that besides the text only the runs take memory."""
    n, span = len(raw) - width + 1, width - gram + 1
    starts, anchors, firsts, lasts = ([np.zeros(0, k)] for k in (np.int64, np.uint64, np.uint64, np.uint64))
    inside, before, end_hash = [np.zeros(0, bool)], -2, np.uint64(0)
    for a in range(0, max(n, 0), chunk):
        b = min(a + chunk, n)
        part = raw[a : b + width - 1]
        h = rolled(part, gram)
        least, have = (((h ^ (h >> np.uint64(31))) * M2) & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at, wide = (least & PLACE).astype(np.int64), rolled(part, width)
        low, high = np.searchsorted(last, a), np.searchsorted(first, b)
        edge = np.zeros(b - a + 1, np.int8)
        np.add.at(edge, np.maximum(first[low:high] - a, 0), 1)
        np.add.at(edge, np.minimum(last[low:high] + 1, b) - a, -1)
        real = np.cumsum(edge[:-1], dtype=np.int8) > 0
        place = np.where(real, at + a, -1)
        new = np.empty(b - a, bool)
        new[0] = place[0] != before
        np.not_equal(place[1:], place[:-1], out=new[1:])
        begins = first[low:high]
        new[begins[begins >= a] - a] = True
        begin = np.flatnonzero(new)
        starts.append(begin + a)
        inside.append(real[begin])
        anchors.append(h[at[begin]])
        firsts.append(wide[begin])
        lasts.append(np.where(begin > 0, wide[begin - 1], end_hash))  # the last window of the run before
        before, end_hash = place[-1], wide[-1]
    start = np.concatenate(starts)
    stop = np.append(start[1:], n)[: len(start)]
    ending = np.append(np.concatenate(lasts)[1:], end_hash)[: len(start)]
    real = np.concatenate(inside)
    start, stop, at, wide, ending = (x[real] for x in (start, stop, np.concatenate(anchors), np.concatenate(firsts), ending))
    return start, stop, (at ^ (at >> np.uint64(29))) * M1, ((wide * M1) ^ (ending >> np.uint64(7))) * M2 + (stop - start).astype(np.uint64)


def distinct(block: Block, codes: np.ndarray, places: np.ndarray, width: int):
    """The shared contexts (from, to, number of the distinct one), and of the distinct ones in order: key (which
    shard), from, to, smallest doc_id. codes, by anchor: 0 alone, 1 shared, 2 shared by very
    many; places: of each run's anchor among them.
    Two contexts of a block are equal if their anchors' and their bytes' 64-bit hashes are."""
    code = codes[places] if len(codes) else np.zeros(0, np.uint8)
    start, stop, key, same = (x[code == 1] for x in (block.start, block.stop, block.hash, block.bytes_hash))
    hot = np.flatnonzero(code == 2)
    if len(hot):
        one = np.concatenate([np.arange(block.start[i], block.stop[i]) for i in hot])
        hashes = np.fromiter((xxhash.xxh64_intdigest(block.text[i : i + width]) for i in one.tolist()), np.uint64, len(one))
        start, stop, key, same = np.concatenate([start, one]), np.concatenate([stop, one + 1]), np.concatenate([key, hashes]), np.concatenate([same, hashes])
    owner = block.ids[np.searchsorted(block.ends, start, "right")]
    order = np.lexsort((same, key))
    if not len(order):
        return start, stop, order, key, start, stop, owner
    k, t = key[order], same[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return start, stop, which, k[first], start[order[first]], stop[order[first]], np.minimum.reduceat(owner[order], first)


def smallest_owners(texts: list[bytes], docs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each context, the smallest doc of an equal window, from the suffix array of all contexts."""
    joined = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    s = joined.astype(np.int64) + 1
    s[-1] = 0
    sa = suffix_array(s)
    common = permuted_common_prefixes(joined, sa)
    window = np.zeros(len(s), bool)
    owner = np.full(len(s), LAST)
    runs = np.repeat(first, size - width + 1) + np.concatenate([np.arange(k) for k in size - width + 1])
    window[runs] = True
    owner[runs] = np.repeat(docs, size - width + 1)
    edge = np.flatnonzero(common[sa] < width)
    least = np.minimum.reduceat(owner[sa], edge)
    result = np.empty(len(s), np.int64)
    result[sa] = np.repeat(least, np.diff(np.append(edge, len(s))))
    return [result[a : a + k] for a, k in zip(first.tolist(), (size - width + 1).tolist(), strict=True)]


def shard_pieces(keys: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Contexts (sorted by key) in pieces of about `most` bytes, cut between keys only."""
    total = np.cumsum(sizes)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    out, begin, base = [], 0, 0
    for i in np.flatnonzero(new)[1:].tolist():
        if total[i - 1] - base >= most:
            out.append(np.arange(begin, i))
            begin, base = i, int(total[i - 1])
    out.append(np.arange(begin, len(keys)))
    return out


PACKED = "block bigint, slice bigint, kind int, a binary, b binary, c binary, d binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
NAMES = ("block", "slice", "kind", "a", "b", "c", "d")


def packed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.table({n: pa.array(c, k) for n, c, k in zip(NAMES, columns, kinds, strict=True)})


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def sliced_keys(keys: np.ndarray, owners: np.ndarray, slices: int, block: int) -> list[tuple]:
    """Sorted distinct keys of a block and how many owners each has there, dealt out by key."""
    at = cuts(keys, slices)
    return [(block, i, 0, planes(np.diff(keys[at[i] : at[i + 1]], prepend=np.uint64(0))), planes(owners[at[i] : at[i + 1]]), None, None) for i in range(slices) if at[i + 1] > at[i]]


def by_owners(hot: int):
    """0 one owner, 1 several, 2 more than `hot`."""
    return lambda owners: np.where(owners > hot, 2, np.where(owners > 1, 1, 0)).astype(np.uint8)


def shared_keys(code_of):
    """For a slice of all blocks: each key's code, by its number of owners, back to its blocks."""

    def shared(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(unplanes(x), dtype=np.uint64) for x in group["a"].to_pylist()]
        n = np.concatenate([unplanes(x) for x in group["b"].to_pylist()]).astype(np.int64)
        every = np.concatenate(parts)
        order = np.argsort(every)
        first = np.flatnonzero(np.concatenate(([True], every[order[1:]] != every[order[:-1]])))
        sums = np.empty(len(every), np.int64)
        sums[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(every))))
        code = code_of(sums)
        back = np.split(code, np.cumsum([len(p) for p in parts])[:-1])
        return packed([(b, s, 0, squeeze(c.tobytes()), None, None, None) for b, s, c in zip(group["block"].to_pylist(), group["slice"].to_pylist(), back, strict=True)])

    return shared


def returned_codes(found: list[dict]) -> np.ndarray:
    rows = sorted((r["slice"], r["a"]) for r in found if r["kind"] == 0)
    return np.frombuffer(b"".join(unsqueeze(a) for _, a in rows), np.uint8)


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, piece_bytes: int = PIECE_BYTES, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """RESULT by document; kept_text (without what a cut leaves of a character) only if with_text; then the columns in carry."""
    ship_package(docs.sparkSession)
    text = docs[text_col].cast("string")
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = slices = max(1, -(-total // block_bytes))
    dealt = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    riding = {c: f"carried_{i}" for i, c in enumerate(carry)}
    whole = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), *(docs[c].alias(a) for c, a in riding.items())).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    wide = RESULT + "".join(f", {riding[c]} {docs.schema[c].dataType.simpleString()}" for c in carry)
    block_of = lambda group: group["block"][0].as_py()

    def anchors(group: pa.Table) -> pa.Table:
        block = Block(group, width, gram)
        own = block.ids[block.docs()]
        order = np.lexsort((own, block.hash))
        h, d = block.hash[order], own[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        other = new | np.concatenate(([True], d[1:] != d[:-1])) if len(h) else new
        keys = h[new]
        n = np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)
        return packed(sliced_keys(keys, n, slices, block_of(group)))

    def codes(block: Block, found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return returned_codes(found), np.unique(block.hash, return_inverse=True)[1]

    def explode(group: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(group, width, gram)
        _, _, _, keys, begin, end, least = distinct(block, *codes(block, found.to_pylist()), width)
        size = (end - begin + width - 1).astype(np.uint64)
        texts = [block.text[a : b + width - 1] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        at, b, rows = cuts(keys, slices), block_of(group) if group.num_rows else 0, []
        for i in range(slices):
            low, high = int(at[i]), int(at[i + 1])
            if high > low:
                rows.append((b, i, 1, planes(np.diff(keys[low:high], prepend=np.uint64(0))), planes(size[low:high]), planes(least[low:high]), squeeze(b"".join(texts[low:high]))))
        return packed(rows)

    def shard(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.cumsum(unplanes(r["a"]), dtype=np.uint64) for r in rows]
        sizes = [unplanes(r["b"]).astype(np.int64) for r in rows]
        texts: list[bytes] = []
        for r, size in zip(rows, sizes, strict=True):
            data, ends = unsqueeze(r["d"]), np.cumsum(size)
            texts += [data[e - k : e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
        docs_ = np.concatenate([unplanes(r["c"]).astype(np.int64) for r in rows])
        every = np.concatenate(keys)
        number: dict[tuple[int, bytes], int] = {}  # equal contexts of several blocks are one
        which = np.fromiter((number.setdefault(x, len(number)) for x in zip(every.tolist(), texts, strict=True)), np.int64, len(texts))
        least = np.full(len(number), LAST)
        np.minimum.at(least, which, docs_)
        key, single = np.array([k for k, _ in number], np.uint64), [t for _, t in number]
        size = np.array([len(t) for t in single], np.int64)
        result: list[np.ndarray] = [None] * len(single)
        order = np.argsort(key, kind="stable")
        k = key[order]
        differs = np.concatenate(([True], k[1:] != k[:-1], [True]))
        alone = differs[1:] & differs[:-1]
        for i in order[alone].tolist():  # nothing else has this anchor: all its windows are its own
            result[i] = np.full(size[i] - width + 1, least[i])
        order = order[~alone]
        for piece in shard_pieces(key[order], size[order], piece_bytes) if len(order) else []:
            chosen = order[piece].tolist()
            for i, w in zip(chosen, smallest_owners([single[i] for i in chosen], least[chosen], width), strict=True):
                result[i] = w
        out = [result[i] for i in which.tolist()]
        back, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            back.append((r["block"], r["slice"], 1, squeeze(planes(np.concatenate(out[at : at + len(k)]))), None, None, None))
            at += len(k)
        return packed(back)

    def mark(group: pa.Table, found: pa.Table) -> pa.Table:
        block, found_rows = Block(group, width, gram), found.to_pylist()
        start, stop, which, _, begin, end, _ = distinct(block, *codes(block, found_rows), width)
        rows = sorted((r["slice"], r["a"]) for r in found_rows if r["kind"] == 1)
        least = np.concatenate([*(unplanes(unsqueeze(a)).astype(np.int64) for _, a in rows), np.zeros(0, np.int64)])
        size = end - begin
        first = np.cumsum(size) - size
        gone = np.zeros(len(block.text) + 1, bool)
        for a in range(0, len(start), CONTEXTS):  # the windows of some contexts at a time
            begin_, run, where = start[a : a + CONTEXTS], (stop - start)[a : a + CONTEXTS], first[which[a : a + CONTEXTS]]
            inner = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
            places = np.repeat(begin_, run) + inner
            owner = block.ids[np.searchsorted(block.ends, begin_, "right")]
            gone[places[least[np.repeat(where, run) + inner] < np.repeat(owner, run)]] = True
        raw = np.frombuffer(block.text, np.uint8)
        sums, texts = [], []
        for low, high in zip((block.ends - block.sizes).tolist(), block.ends.tolist(), strict=True):  # a document at a time
            starts = gone[low : max(high - width + 1, low)]
            if starts.any():
                lost = covered(starts, width, high - low)
                kept, cut = raw[low:high][~lost].tobytes(), np.count_nonzero(lost)
                runs = int(lost[0]) + np.count_nonzero(lost[1:] & ~lost[:-1])
            else:
                kept, cut, runs = block.text[low:high], 0, 0
            sums.append((cut, runs, hashlib.sha256(kept).hexdigest()))
            texts.append(kept.decode("utf-8", "ignore") if with_text else None)
        cut, runs, digests = zip(*sums, strict=True) if sums else ((), (), ())
        return pa.table({
            "doc_id": block.given, "n_bytes": pa.array(block.sizes), "n_removed": pa.array(cut, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string()),
            **{a: group[a] for a in riding.values()},
        })

    by_block = dealt.repartition(blocks, "block").groupBy("block")
    shared = by_block.applyInArrow(lean(anchors), PACKED).repartition(slices, "slice").groupBy("slice").applyInArrow(lean(shared_keys(by_owners(hot))), PACKED)
    known = stash(shared, "shared_anchors")
    contexts = by_block.cogroup(known.repartition(blocks, "block").groupBy("block")).applyInArrow(lean(explode), PACKED)
    owners = contexts.repartition(slices, "slice").groupBy("slice").applyInArrow(lean(shard), PACKED)
    found = stash(known.unionByName(owners), "window_owners")
    marked = whole.repartition(blocks, "block").groupBy("block").cogroup(found.repartition(blocks, "block").groupBy("block")).applyInArrow(lean(mark), wide)
    return marked.withColumnsRenamed({a: c for c, a in riding.items()})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(documents(spark, sf_dir)).drop("kept_text")


#: Every window of WIDTH bytes, as hexadecimal digits, with the smallest document it starts in; runs of removed bytes are
#: those that windows cover without a gap.
ORACLE = f"""WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, {2 * WIDTH})) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, n - {WIDTH})) AS i FROM d WHERE n >= {WIDTH})),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g), x AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE doc_id > first),
b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM x),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b), r AS (SELECT doc_id, span, min(i) AS low, max(i) + {WIDTH} AS high FROM k GROUP BY ALL),
e AS (SELECT doc_id, span, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM r),
t AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans, max(high) AS last, string_agg(substring(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY span) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
