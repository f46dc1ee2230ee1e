"""Exact token counts at every prefix, by dynamic programming over prefixes.

Within a piece (a match of the tokenizer's pattern), the encoding of each prefix is the encoding of a
shorter prefix and one more token: count[p] = count[q] + 1 for the one token from q to p that may follow
the last token of the prefix q. What is stored for a text is the change of the count at each byte, one
signed byte each and compressed; its running sum is the number of tokens of every prefix of the text,
as if that prefix alone were encoded. Budgets, truncation and limits are then answered from the stored
table, without encoding again.

Where a prefix is split otherwise than the whole text, the table follows the prefix: after a run of
blanks that ends inside the text, inside a contraction, and inside a special token's string.

Defined cases: a null text counts as empty and has 0 tokens; a prefix that ends within a character counts
that character's bytes as they stand; rows that repeat each have a table; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grainfold.llm.bpe import PAIR_COST, PIECE_BYTES, Pairs
from grainfold.llm.common import cache_share, documents, map_texts, stash

#: CACHE_BYTES: what the workers of one executor may remember together, pieces and verdicts on pairs.
CODEC, CACHE_BYTES, PIECE_COST = "zstd", 768 << 20, 200


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies in JSON write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_json(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Merge ranks (ids in order of merging) and special tokens of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = [t["content"] for t in spec["added_tokens"]]
    return {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}, special


class PrefixTable:
    """Remembers pieces and pairs within cache_bytes, half of them each; when the pieces' half is full, all are forgotten."""

    def __init__(self, ranks: dict[bytes, int], special: list[str], pattern: str, cache_bytes: int = 64 << 20):
        import regex

        self.pairs, self.bound, self.known, self.held = Pairs(ranks, max(1, cache_bytes // 2 // PAIR_COST)), cache_bytes // 2, {}, 0
        self.heads = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.blank = regex.compile(r"\s+").fullmatch
        self.contractions = {f"'{x}" for x in ("re", "ve", "ll")}

    def steps(self, piece: bytes) -> bytes:
        """The change of the count at each byte of a piece. low: before it, no token can begin that reaches this far."""
        ranks, known, fit, heads = self.pairs.ranks.get, self.pairs.known.get, self.pairs.fit, self.heads
        lasts, counts, out, low, was = [-1], [0], bytearray(), 0, 0
        for end in range(1, len(piece) + 1):
            while piece[low:end] not in heads:
                low += 1
            for q in range(low, end):
                token = ranks(piece[q:end])
                if token is not None:
                    ok = known((lasts[q], token))
                    if ok or ok is None and fit(lasts[q], token):
                        break
            lasts.append(token)
            now = counts[q] + 1
            counts.append(now)
            out.append(now - was & 255)
            was = now
        return bytes(out)

    def piece(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        out = self.steps(raw)
        if word in self.contractions:  # a prefix of it is an apostrophe and letters, apart
            total = sum(np.frombuffer(out, np.int8))
            out = np.array([1, 1, total - 2], np.int8).tobytes()
        if len(raw) <= PIECE_BYTES:
            self.held += PIECE_COST + 3 * len(raw)
            if self.held > self.bound:
                self.known.clear()
                self.pairs.known.clear()
                self.held = PIECE_COST + 3 * len(raw)
            self.known[word] = out
        return out

    def plain(self, text: str) -> np.ndarray:
        """Changes for a text without special tokens, as int8."""
        get, make = self.known.get, self.piece
        words = self.split(text)
        parts = [get(w) or make(w) for w in words]
        out = np.frombuffer(b"".join(parts), np.int8)
        blank = [i for i, w in enumerate(words[:-1]) if w.isspace() and self.blank(w) and self.blank(words[i + 1][0])]
        if blank:
            out = out.copy()
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            for i in blank:  # the prefix that ends behind the run's last blank has the run as one piece
                run, first = words[i] + words[i + 1][0], len(words[i + 1][0].encode())
                whole = int(np.frombuffer(get(run) or make(run), np.int8).sum()) - int(np.frombuffer(parts[i], np.int8).sum())
                at = int(ends[i])
                now = int(out[at : at + first].sum())
                out[at + first - 1] += whole - now
                out[at + first : at + first + 1] -= np.int8(whole - now)
        return out

    def table(self, text: str) -> np.ndarray:
        if not self.special or not (found := list(self.special.finditer(text))):
            return self.plain(text)
        out, at = [], 0
        for m in found:
            head = self.plain(text[at : m.start()])
            inner = self.plain(text[at : m.end() - 1])  # its prefixes end inside the special token
            out.append(inner)
            out.append(np.array([int(head.sum()) + 1 - int(inner.sum())], np.int8))
            at = m.end()
        out.append(self.plain(text[at:]))
        return np.concatenate(out)


@lru_cache(1)
def prefix_table(path: str, pattern: str, cache_bytes: int) -> PrefixTable:
    """One for each worker process, so that its tables outlive a task."""
    return PrefixTable(*load_json(path), pattern, cache_bytes)


def counts(table: bytes, size: int) -> np.ndarray:
    """Tokens of every prefix, from the empty one to the whole text."""
    steps = np.frombuffer(pa.decompress(table, decompressed_size=size, codec=CODEC, asbytes=True), np.int8) if size else np.zeros(0, np.int8)
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int32)))


STORED = "doc_id bigint, n_bytes bigint, n_tokens bigint, prefix_steps binary"


def prefix_tables(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """For each document its size, its tokens and the table of all its prefixes, to be stored."""
    share = cache_share(docs.sparkSession, cache_bytes)

    def make():
        table = prefix_table(tokenizer_path, pattern, share)

        def work(batch):
            n, total, steps = [], [], []
            for text in batch["text"]:
                made = table.table(text.as_py() or "")
                n.append(len(made))
                total.append(int(made.sum(dtype=np.int64)))
                steps.append(pa.compress(made.tobytes(), codec=CODEC, asbytes=True) if len(made) else b"")
            columns = {"doc_id": batch["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_tokens": pa.array(total, pa.int64()), "prefix_steps": pa.array(steps, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

        return work

    return map_texts(docs, id_col, text_col, make, STORED)


BUDGET = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, bytes_in_limit bigint"


def within_budget(tables: DataFrame, limit: int) -> DataFrame:
    """From stored tables alone: whether a document is over the limit, and its longest prefix (bytes) within it."""

    def run(batches):
        for batch in batches:
            cut, n = [], batch["n_bytes"].to_pylist()
            for size, total, steps in zip(n, batch["n_tokens"].to_pylist(), batch["prefix_steps"].to_pylist(), strict=True):
                cut.append(size if total <= limit else int(np.flatnonzero(counts(steps, size) <= limit)[-1]))
            over = pa.array([t > limit for t in batch["n_tokens"].to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], batch["n_tokens"], over, pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_in_limit"])

    return tables.select("doc_id", "n_bytes", "n_tokens", "prefix_steps").mapInArrow(run, BUDGET)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = prefix_tables(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return within_budget(stash(made, "prefix_tables"), 512)
