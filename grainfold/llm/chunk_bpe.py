"""BPE with word ends, encoding each content-defined chunk that texts share once, and decoding.

A normalised text is cut where a rolling hash of its last bytes says so, so that texts that share a passage share its
chunks whatever stands before it. Chunks' digests are counted over the corpus; those met twice or more set bits in a
filter of fixed size, which is broadcast. A chunk that the filter passes is encoded once for the whole corpus, and its
tokens are joined to all texts that hold it. (One that passes by chance is encoded by the same path: the filter
decides where work is done, not what comes out, and a full one only means that more chunks take that path.)

A cut may fall inside a word. So a chunk's own tokens are kept between its first and its last space only, where no
token crosses whatever stands outside; the stretch between two such cores is encoded again, over as many chunks
as it takes until there is a space to agree at. What no text shares is encoded in the same stretches, where it stands.

Words are encoded by merging the pair of lowest rank, leftmost first: short ones in a list, long ones with a heap.

Defined cases: a null or empty text has no tokens; a text without a space is one stretch; special tokens' strings are
cut out of the text as it was written, each one token; rows that repeat are handled one by one; an empty table gives no
rows. Characters that Unicode got after version 15 may be classed otherwise than by the library. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import cache_share, claim, documents, join_counted, map_texts, remembers, stash
from grainfold.llm.token_counts import byte_letters

#: A cut is made where BITS bits of the hash of WINDOW bytes are zero, LEAST bytes after the cut before at the earliest.
BITS, WINDOW, LEAST = 9, 16, 64
#: Bits of the filter (8 MB), and bytes that the workers of one executor may remember together.
FILTER_BITS, CACHE_BYTES, WORD_COST = 1 << 26, 448 << 20, 210
LIST_MERGE, LONG = 64, 1 << 60


class Words:
    """Tokens of one word: a piece of the pattern, its last byte with the mark of a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = {b: c for c, b in byte_letters().items()}
        self.inner, self.final = ([vocab[letters[b] + tail] for b in range(256)] for tail in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]

    def encode(self, word: bytes) -> list[int]:
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        return self.by_list(ids) if len(ids) <= LIST_MERGE else self.by_heap(ids)

    def by_list(self, ids: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, LONG) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < LONG:
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], LONG)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], LONG)
        return ids

    def by_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: places are linked, and a pair in the heap counts if it is still there."""
        rank, made, n = self.rank.get, self.made, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], LONG)) < LONG]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j], LONG) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (x := rank(ids[a] << 32 | ids[b], LONG)) < LONG:
                    heapq.heappush(heap, (x, a))
        return [t for t in ids if t >= 0]


class WordTokenizer:
    """Normalises, splits, encodes and decodes as the tokenizer file says. Remembers words within cache_bytes."""

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["unk_token"] or model["byte_fallback"]:
            raise ValueError(f"not a lower-casing BPE with word ends: {path}")
        self.words = Words(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.blanks = regex.compile(r"[^\S ]\s*| \s+").sub
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]
        table = model["vocab"] | special
        self.tokens = [b""] * (max(table.values()) + 1)
        for text, i in table.items():
            self.tokens[i] = text.encode()
        self.known, self.older, self.held, self.bound = {}, {}, 0, cache_bytes

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() minds where a sigma stands
        return self.blanks(" ", text).lower()

    def segments(self, text: str) -> list[str | int]:
        """Normalised stretches of text and ids of special tokens, in their order."""
        return [self.special[s] if s in self.special else self.normal(s) for s in self.cut(text) if s]

    def remember(self, word: str, ids: bytes) -> bytes:
        """Two generations, each within half of the bound; the older one goes when the younger one is full."""
        if len(word) <= LIST_MERGE:
            self.held += WORD_COST + 2 * len(word)
            if self.held > self.bound // 2:
                self.older, self.known, self.held = self.known, {}, WORD_COST
            self.known[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.words.encode(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}H", *ids)

    def word(self, word: str) -> bytes:
        """What stands between two spaces: one piece of the pattern or more, none of which crosses a space."""
        ids = self.older.get(word)
        if ids is None:
            pieces, find = self.split(word), self.known.get
            ids = self.piece(word) if pieces == [word] else b"".join([find(p) or self.remember(p, self.piece(p)) for p in pieces])
        return self.remember(word, ids)

    def encode(self, normal: str) -> bytes:
        """Ids of normalised text, two bytes each."""
        get, make = self.known.get, self.word
        out, known = [], self.known
        for w in normal.split(" "):
            if w:
                ids = get(w)
                if ids is None:
                    ids = make(w)
                    if self.known is not known:
                        known, get = self.known, self.known.get
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(1)
def tokenizer(path: str, cache_bytes: int) -> WordTokenizer:
    """One for each worker process, so that its table outlives a task."""
    made = WordTokenizer(path, cache_bytes)
    remembers("chunk_bpe", made.forget)
    return made


def gears() -> np.ndarray:
    """256 odd 32-bit numbers, by a fixed rule."""
    return np.frombuffer(b"".join(hashlib.blake2b(bytes((b,)), digest_size=4).digest() for b in range(256)), "<u4") | np.uint32(1)


GEARS, FACTOR = gears(), 0x01000193


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, each at the border of a character; the last is the text's."""
    row = np.frombuffer(raw, np.uint8)
    rolled, width, factor = GEARS[row], 1, FACTOR
    while width < WINDOW:
        rolled[width:] += rolled[:-width] * np.uint32(factor)
        width, factor = 2 * width, factor * factor & 0xFFFFFFFF
    out, last = [], 0
    for at in (np.flatnonzero(rolled[WINDOW - 1 :] >> np.uint32(32 - BITS) == 0) + WINDOW).tolist():
        if at - last >= LEAST:
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            if at < len(raw):
                out.append(at)
                last = at
    return [*out, len(raw)] if raw else []


def chunks(normal: str) -> list[tuple[bytes, bytes]]:
    """(text, digest) of the chunks of normalised text."""
    raw, start, out = normal.encode("utf-8", "surrogatepass"), 0, []
    for end in cuts(raw):
        out.append((raw[start:end], hashlib.blake2b(raw[start:end], digest_size=16).digest()))
        start = end
    return out


def hashes(docs: DataFrame, path: str, share: int, id_col: str, text_col: str) -> DataFrame:
    """h: 64 bits of the digest of each chunk of each text."""

    def make():
        claim("chunk_bpe")
        words = tokenizer(path, share)

        def work(batch):
            for text in batch["text"]:
                found = [d[:8] for s in words.segments(text.as_py() or "") if isinstance(s, str) for _, d in chunks(s)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(found), "<i8"))], ["h"])

        return grouped(work)

    return map_texts(docs, id_col, text_col, make, "h bigint")


def grouped(work, rows: int = 512):
    """work with its many small batches put together."""

    def run(batch):
        for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
            yield from pa.Table.from_batches(list(work(part))).combine_chunks().to_batches()

    return run


def shared_filter(found: DataFrame) -> np.ndarray:
    """A Bloom filter, of FILTER_BITS bits and two places a key, of the hashes that occur more than once."""
    places = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.explode(F.expr(f"array(h & {FILTER_BITS - 1}L, shiftrightunsigned(h, 32) & {FILTER_BITS - 1}L)")).alias("at")
    )
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    got, out = words.toArrow(), np.zeros(FILTER_BITS // 64, np.int64)  # FILTER_BITS / 64 rows at most
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def passes(bits: np.ndarray, digests: list[bytes]) -> list[bool]:
    h = np.frombuffer(b"".join(d[:8] for d in digests), "<u8")
    ok = np.ones(len(h), bool)
    for at in (h & np.uint64(FILTER_BITS - 1), h >> np.uint64(32) & np.uint64(FILTER_BITS - 1)):
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)].view("<u8") >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok.tolist()


def stretches(words: WordTokenizer, bits: np.ndarray, text: str) -> tuple[list[bytes], list[bytes], dict[bytes, bytes]]:
    """Tokens of the stretches before, between and behind the cores, the cores' digests, and each core's text."""
    gaps, refs, cores, now = [], [], {}, []
    for part in words.segments(text):
        if isinstance(part, int):
            now.append(np.array([part], "<u2").tobytes())
            continue
        found, start, done = chunks(part), 0, 0
        raw = part.encode("utf-8", "surrogatepass")
        for (chunk, digest), ok in zip(found, passes(bits, [d for _, d in found]), strict=True):
            if ok:
                a, b = chunk.find(b" "), chunk.rfind(b" ")
                if a < b:  # else the stretch goes on over this chunk
                    now.append(words.encode(raw[done : start + a].decode("utf-8", "surrogatepass")))
                    gaps.append(b"".join(now))
                    refs.append(digest)
                    cores[digest] = chunk[a:b]
                    now, done = [], start + b
            start += len(chunk)
        now.append(words.encode(raw[done:].decode("utf-8", "surrogatepass") if done else part))
    return [*gaps, b"".join(now)], refs, cores


RESULT = "n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
PLAN = f"kind string, key bigint, doc_id bigint, gaps array<binary>, refs array<binary>, digest binary, core binary, {RESULT}"


def finished(words: WordTokenizer, ids: bytes, digests: bool) -> tuple:
    """The RESULT of a whole text: digests of ids and of what they decode to, or the ids."""
    if not digests:
        return len(ids) // 2, ids, None, None
    row = np.frombuffer(ids, "<u2")
    return len(row), None, hashlib.sha256(row.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(row)).hexdigest()


def planned(docs: DataFrame, bits, path: str, share: int, digests: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds: 'done', texts without a shared chunk; 'open', with some; 'core', the cores, once a task at least."""

    def make():
        from pyspark import TaskContext

        claim("chunk_bpe")
        words, key, seen = tokenizer(path, share), TaskContext.get().partitionId() << 40, set()

        def work(batch):
            nonlocal key
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                gaps, refs, cores = stretches(words, bits.value, text.as_py() or "")
                key += 1
                if refs:
                    rows.append(("open", key, doc_id, gaps, refs, None, None, None, None, None, None))
                else:
                    rows.append(("done", key, doc_id, None, None, None, None, *finished(words, gaps[0], digests)))
                new = cores.keys() - seen
                rows += [("core", None, None, None, None, d, cores[d], None, None, None, None) for d in new]
                if len(seen) > 1 << 19:
                    seen.clear()
                seen.update(new)
            yield table(rows, PLANNED)

        return lambda batch: (out for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)) for out in work(part))

    return map_texts(docs, id_col, text_col, make, PLAN)


BINARIES, NUMBER, TEXT = pa.list_(pa.binary()), pa.int64(), pa.string()
RESULTS = [("n_tokens", NUMBER), ("ids", pa.binary()), ("ids_sha256", TEXT), ("decoded_sha256", TEXT)]
PLANNED = pa.schema([("kind", TEXT), ("key", NUMBER), ("doc_id", NUMBER), ("gaps", BINARIES), ("refs", BINARIES), ("digest", pa.binary()), ("core", pa.binary()), *RESULTS])


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def encoded(docs: DataFrame, path: str, digests: bool, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id and the RESULT of each row's text; see finished()."""
    spark = docs.sparkSession
    share = cache_share(spark, cache_bytes)
    bits = spark.sparkContext.broadcast(shared_filter(hashes(docs, path, share, id_col, text_col)))
    plan = stash(planned(docs, bits, path, share, digests, id_col, text_col), "stretches", by=("kind",))

    def encode(batches):
        claim("chunk_bpe")
        words = tokenizer(path, share)
        for batch in batches:
            made = [words.encode(c.decode("utf-8", "surrogatepass")) for c in batch["core"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(made, pa.binary())], ["digest", "tokens"])

    refs = plan.where("kind = 'open'").select("key", F.posexplode("refs").alias("pos", "digest"))
    cores = plan.where("kind = 'core'").groupBy("digest").agg(F.first("core").alias("core")).mapInArrow(encode, "digest binary, tokens binary")
    uses = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("uses"))
    store = stash(cores.join(uses.hint("merge"), "digest"), "cores")
    parts = join_counted(refs, store, "digest", "uses").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "tokens")))["tokens"].alias("tokens"))
    open_rows = plan.where("kind = 'open'").select("key", "doc_id", "gaps").join(parts.hint("merge"), "key").drop("key")

    def assemble(batches):
        claim("chunk_bpe")
        words, schema = tokenizer(path, share), pa.schema([("doc_id", NUMBER), *RESULTS])
        for batch in batches:
            rows = []
            for doc_id, gaps, cores in zip(*(batch[c] for c in ("doc_id", "gaps", "tokens")), strict=True):
                pieces = [x for pair in zip(gaps.as_py(), [*cores.as_py(), b""], strict=True) for x in pair]
                rows.append((doc_id.as_py(), *finished(words, b"".join(pieces), digests)))
            yield table(rows, schema)

    joined = open_rows.mapInArrow(assemble, f"doc_id bigint, {RESULT}")
    return plan.where("kind = 'done'").select(*joined.columns).unionByName(joined)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (two bytes each, little-endian)."""
    return encoded(docs, path, False, id_col, text_col).select("doc_id", "n_tokens", "ids")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids as encode_documents() gives them: tokens' strings, joined by one space."""
    share = cache_share(tokens.sparkSession, CACHE_BYTES)

    def run(batches):
        words = tokenizer(path, share)
        for batch in batches:
            texts = [words.decode(np.frombuffer(x or b"", "<u2")).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
