"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is (merging the two
tokens' bytes gives these two tokens again). So each prefix of a piece has one last token, and the
encodings of all prefixes form a tree. The transducer reads bytes; its state is the last token that is
certain and the bytes after it. A place is live while the bytes after it can still begin a token. As soon
as all live places have the same first token, that token is emitted: the lookahead is bounded by the
longest token. States and their transitions are made when first reached, kept under a fixed bound and
thrown away together when it is met, which changes the speed only.

Texts are split by the tokenizer's pattern first; each match is a piece of its own.
Defined cases: a null or empty text has no tokens; very long pieces (blanks, one letter repeated) run
through the same states; bytes that aren't UTF-8 are decoded to U+FFFD when text is asked for; rows that repeat are encoded
one by one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grainfold.llm.common import cache_share, documents, map_texts

#: What the workers of one executor may remember together: a third for pieces, of the rest three quarters for states and one
#: for pairs; the longest remembered piece; what a piece, a pair and a transition with its state take, besides their own bytes.
CACHE_BYTES, PIECE_BYTES, PIECE_COST, PAIR_COST, MOVE_COST = 1536 << 20, 64, 220, 160, 320


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pairs:
    """Which token may stand after which. At most `bound` verdicts are remembered, of PAIR_COST bytes each."""

    def __init__(self, ranks: dict[bytes, int], bound: int = 1_000_000):
        self.bound = bound
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.known: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Plain merging, lowest rank first, of ranks under a bound."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for what no merge makes."""
        if token not in self.parts:
            made = self.merged(self.bytes[token], below=token)
            self.parts[token] = (made[0], made[1]) if len(made) == 2 else None
        return self.parts[token]

    def stand(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens, the latest first: no merge across the border may come before one undone."""
        names, get, bound = self.bytes, self.ranks.get, 1 << 60
        while True:
            if get(names[a] + names[b], 1 << 60) < bound:
                return False
            left, right = self.halves(a), self.halves(b)
            if left and (not right or a > b):
                a, bound = left[1], a
            elif right:
                b, bound = right[0], b + 1
            else:
                return True

    def fit(self, a: int, b: int) -> bool:
        """May b follow a? a = -1: may b stand first?"""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.bound:
                self.known.clear()
            found = self.known[a, b] = self.stand(a, b) if a >= 0 else len(self.bytes[b]) == 1 or self.halves(b) is not None
        return found

    def last(self, piece: bytes, lasts: list[int], before: int) -> tuple[int, int]:
        """(start, token) of the last token of piece; lasts[q]: the last token of piece[:q], -2 where there is none."""
        end, ranks, fit = len(piece), self.ranks, self.fit
        for q in range(max(0, end - self.longest), end):
            token = ranks.get(piece[q:])
            if token is not None and (a := lasts[q] if q else before) != -2 and fit(a, token):
                return q, token
        return -1, -2


class Transducer:
    """A state's live places, each as a node of the tree of tokens and the tokens that lead there, are flat in one tuple, the place
    behind the last byte at its end. Nodes and states are numbered in steps of 256, so that a byte can be added to them."""

    def __init__(self, ranks: dict[bytes, int], cache_bytes: int = CACHE_BYTES // 4):
        self.pairs, self.bound = Pairs(ranks, max(1, cache_bytes // 4 // PAIR_COST)), max(1, cache_bytes * 3 // 4 // MOVE_COST)
        heads = {t[:i] for t in ranks for i in range(1, len(t))}
        nodes = {b"": 0} | {h: n << 8 for n, h in enumerate(heads, 1)}
        self.below = {nodes[t[:-1]] | t[-1]: (ranks.get(t, -1), nodes.get(t, 0)) for t in heads | ranks.keys()}
        self.reset()

    def reset(self) -> None:
        start = 0, (-1,)
        self.places: list[tuple] = [start]
        self.states: dict[tuple, int] = {start: 0}  # the start and those behind an emission; others have one way to them
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state behind one more byte and the tokens that are certain then: those that all live places begin with."""
        get, fit, live, made = self.below.get, self.pairs.fit, [], None
        pairs = iter(self.places[s >> 8])
        for node, tokens in zip(pairs, pairs):
            if found := get(node | byte):
                token, node = found
                if token >= 0 and made is None and fit(tokens[-1], token):
                    made = *tokens, token
                if node:
                    live += node, tokens
        live += 0, made
        first = live[1]
        same = len(first)
        if same > 1:
            for tokens in live[3::2]:
                at = 1
                while at < same and at < len(tokens) and tokens[at] == first[at]:
                    at += 1
                same = at
        out, n = first[1:same], None
        if out:
            live[1::2] = [tokens[same - 1 :] for tokens in live[1::2]]
        places = tuple(live)
        if out:
            n = self.states.get(places)
        if n is None:
            n = len(self.places) << 8
            self.places.append(places)
            if out:
                self.states[places] = n
        done = self.moves[s | byte] = n, out
        return done

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > self.bound:
            self.reset()
        moves, s, out = self.moves, 0, []
        for byte in piece:
            s, more = moves.get(s | byte) or self.step(s, byte)
            if more:
                out += more
        out += self.places[s >> 8][-1][1:]
        return out


@lru_cache(4)
def encoder(path: str, pattern: str, cache_bytes: int) -> Encoder:
    """One for each worker process, so that its tables and states outlive a task."""
    return Encoder(load_ranks(path), pattern, cache_bytes)


@contextlib.contextmanager
def uncollected():
    """No search for circular garbage meanwhile: it would walk all states again and again, and they refer to none of their own."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_ranges(pattern: str) -> str | None:
    """The pattern for the standard library, classes of characters below U+10000 as ranges; None if it has other escapes."""
    import regex

    every, inside, out = "".join(map(chr, range(0x10000))), False, []
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|\[\^?|.", pattern, re.DOTALL):
        if part[0] == "\\":
            if part[1] not in "psS" or inside and part[1] == "S":
                return None
            ranges: list[list[int]] = []
            for c in map(ord, regex.findall(part.lower() if part[1] == "S" else part, every)):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
            listed = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)
            part = listed if inside else f"[{'^' * (part[1] == 'S')}{listed}]"
        elif part[0] in "[]":
            inside = part[0] == "["
        out.append(part)
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern. The standard library finds them in half of regex's time; texts with characters from U+10000
    on, for which its classes are slow, are left to regex."""
    import regex

    every, made = regex.compile(pattern).findall, with_ranges(pattern)
    if made is None:
        return every
    below = re.compile(made).findall
    return lambda text: below(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else every(text)


class Known(dict):
    """word -> its ids, made when first asked for."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.make(word)


class Encoder:
    """Pieces are remembered in two halves: when the younger is full, the older is thrown away and the younger takes its place, so
    that pieces asked for meanwhile stay."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES // 4):
        self.transducer, self.split, self.bound, self.held = Transducer(ranks, cache_bytes - cache_bytes // 3), splitter(pattern), cache_bytes // 6, 0
        self.known, self.older = Known(self.piece), {}

    def piece(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.transducer.encode(raw))
        if len(raw) <= PIECE_BYTES:
            self.held += PIECE_COST + len(raw)
            if self.held > self.bound:
                self.older = dict(self.known)
                self.known.clear()
                self.held = PIECE_COST + len(raw)
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))


def utf8_transitions() -> list[list[int]]:
    """state -> byte -> state: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 behind a lead whose next
    byte is narrower (no overlong forms, no surrogates, nothing above U+10FFFF), 8 what no character can hold."""
    wrong, back = 8, range(0x80, 0xC0)
    table = [[wrong] * 256 for _ in range(9)]
    leads = {0: range(0x80), 1: range(0xC2, 0xE0), 2: range(0xE1, 0xF0), 3: range(0xF1, 0xF4), 4: (0xE0,), 5: (0xED,), 6: (0xF0,), 7: (0xF4,)}
    for state, bytes_ in leads.items():
        for b in bytes_:
            table[0][b] = state
    table[0][0xED] = 5
    after = {1: (0, back), 2: (1, back), 3: (2, back), 4: (1, range(0xA0, 0xC0)), 5: (1, range(0x80, 0xA0)), 6: (2, range(0x90, 0xC0)), 7: (2, range(0x80, 0x90))}
    for state, (then, bytes_) in after.items():
        for b in bytes_:
            table[state][b] = then
    return table


UTF8 = utf8_transitions()


class Utf8Machine:
    """An incremental UTF-8 reader: push() returns all bytes that are settled, whole characters and what belongs to none.

    A byte that isn't a continuation starts anew, whatever came before, so the state at the end of a chunk is
    that of the machine run from the last such byte on, at most four bytes back.
    """

    def __init__(self):
        self.tail = b""

    def push(self, chunk: bytes) -> bytes:
        data = self.tail + chunk
        start = len(data) - 1
        while start > max(0, len(data) - 4) and data[start] & 0xC0 == 0x80:
            start -= 1
        state = 0
        for byte in data[max(start, 0) :]:
            state = UTF8[state][byte]
        keep = len(data) - start if 0 < state < 8 else 0
        self.tail = data[len(data) - keep :]
        return data[: len(data) - keep]

    def end(self) -> bytes:
        tail, self.tail = self.tail, b""
        return tail


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.table: list[bytes | None] = [None] * size
        for k, v in ranks.items():
            self.table[v] = k

    def stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[bytes]:
        machine, buffer = Utf8Machine(), []
        for token in ids:
            buffer.append(self.table[token])
            if len(buffer) == chunk:
                yield machine.push(b"".join(buffer))
                buffer.clear()
        yield machine.push(b"".join(buffer))
        yield machine.end()

    def bytes(self, ids: list[int], chunk: int = 65536) -> bytes:
        machine, get = Utf8Machine(), self.table.__getitem__
        parts = [machine.push(b"".join(map(get, ids[i : i + chunk]))) for i in range(0, len(ids), chunk)]
        return b"".join([*parts, machine.end()])

    def text(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the operator's plain output."""
    share = cache_share(docs.sparkSession, CACHE_BYTES)

    def make():
        made = encoder(ranks_path, pattern, share)

        def work(batch):
            with uncollected():
                ids = [made.encode(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return work

    return map_texts(docs, id_col, text_col, make, "doc_id bigint, ids array<int>")


def decode_documents(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from doc_id, ids."""
    frame = tokens.select(tokens[id_col].cast("bigint").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids"))

    def run(batches):
        decoder = Decoder(load_ranks(ranks_path))
        for batch in batches:
            texts = [decoder.text(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return frame.mapInArrow(run, "doc_id bigint, text string")


ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, and return counts and digests; the ids stay in the worker."""
    share = cache_share(docs.sparkSession, CACHE_BYTES)

    def make():
        made = encoder(ranks_path, pattern, share)
        decoder = Decoder(made.transducer.pairs.ranks)
        decimal = [str(i).encode() for i in range(len(decoder.table))].__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(batch):
            n, a, b = [], [], []
            with uncollected():
                for text in batch["text"]:
                    ids = made.encode(text.as_py() or "")
                    n.append(len(ids))
                    a.append(sha(b" ".join(map(decimal, ids))))
                    b.append(sha(decoder.bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_texts(docs, id_col, text_col, make, ROUND_TRIP)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
