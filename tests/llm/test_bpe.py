import hashlib
import itertools
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from grainfold.llm import bpe, token_counts

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " ", "  ", "\n", "\n\n", "'ll", "'", "'re", "I've", "é", "ß", "日本", "🙂", "12", "===", "aaaaaaaa", "Ther***", "\t", "\xa0", "x", "\x1c", "ing", "tion", "́", "  ", "don't"]


def texts(n, seed=7):
    rnd = random.Random(seed)
    return ["", " ", "a" * 3000, " " * 2999 + "x", "\n" * 1000, "=" * 777, *("".join(rnd.choices(PARTS, k=rnd.randint(1, 25))) for _ in range(n))]


@pytest.mark.parametrize("states", [60_000, 50])
def test_transducer_encodes_as_the_library(states):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_bytes=60_000)
    encoder.transducer.bound = states
    decoder = bpe.Decoder(RANKS)
    for text in texts(1500):
        ids = encoder.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert decoder.text(ids) == text
        assert b"".join(decoder.stream(ids, chunk=3)).decode() == text


def test_transducer_on_random_bytes():
    rnd = random.Random(3)
    machine = bpe.Transducer(RANKS)
    for _ in range(3000):
        piece = bytes(rnd.choices(b"aeinorst th\xc3\xa9\xff01", k=rnd.randint(1, 30)))
        assert machine.encode(piece) == machine.pairs.merged(piece)


def test_utf8_machine_never_splits_a_character():
    raw = "aé日🙂".encode() * 5
    for step in range(1, 6):
        m = bpe.Utf8Machine()
        parts = [m.push(raw[i : i + step]) for i in range(0, len(raw), step)]
        for p in parts:
            p.decode()
        assert b"".join([*parts, m.end()]) == raw


def test_prefix_counts_equal_encoding_each_prefix():
    library = Tokenizer.from_file(JSON)
    ranks, special = token_counts.load_json(JSON)
    assert special == ["<|endoftext|>"]
    table = token_counts.PrefixTable(ranks, special, public_tokenizers.PATTERN, cache_bytes=60_000)
    for text in [*texts(250, 11)[6:], "a  b", "x <|endoftext|> y<|endoftext|>", "I'll 'l <|endoftext", "   \n  \n z", "ab" + " " * 40 + "c"]:
        steps = table.table(text)
        counts = [0, *steps.cumsum(dtype=int)]
        assert len(steps) == len(text.encode())
        for k in range(len(text) + 1):
            head = text[:k]
            assert counts[len(head.encode())] == len(library.encode(head, add_special_tokens=False).ids), (text, k)
    long = table.table("word " * 4000 + " " * 5000)
    assert long.sum(dtype=int) == len(library.encode("word " * 4000 + " " * 5000).ids)


TAILS = [bytes(t) for k in (1, 2, 3) for t in itertools.product((0x80, 0x90, 0x9F, 0xA0, 0xBF), repeat=k)]


class Characters:
    def __contains__(self, raw):
        try:
            return len(raw.decode()) == 1
        except UnicodeDecodeError:
            return False


CHARACTERS = Characters()
EDGE = [None, "", " ", "x <|endoftext|> é 日本🙂", "word " * 30_000, "same", "same", "'ll   \n", "word " * 30_000]


def test_stored_tables_answer_budgets(frame):
    library = Tokenizer.from_file(JSON)
    docs, size = frame(EDGE), [len(library.encode(t or "", add_special_tokens=False).ids) for t in EDGE]
    stored = token_counts.prefix_tables(docs, JSON, public_tokenizers.PATTERN)
    for limit in (0, 3, 512):
        rows = {r["doc_id"]: r for r in token_counts.within_budget(stored, limit).collect()}
        little = {r["doc_id"]: r for r in token_counts.within_budget(token_counts.prefix_tables(docs, JSON, public_tokenizers.PATTERN, cache_bytes=4000), limit).collect()}
        assert rows == little and len(rows) == len(EDGE)
        for i, t in enumerate(EDGE):
            raw, r = (t or "").encode(), rows[i]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(raw), size[i], size[i] > limit)
            head = raw[: r["bytes_in_limit"]].decode("utf-8", "ignore")
            assert len(library.encode(head, add_special_tokens=False).ids) <= limit and (size[i] > limit) == (r["bytes_in_limit"] < len(raw))
    assert token_counts.within_budget(token_counts.prefix_tables(frame([]), JSON, public_tokenizers.PATTERN), 5).count() == 0


def test_what_a_worker_remembers_is_bounded_by_bytes():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_bytes=40_000)
    for text in texts(400):
        encoder.encode(text)
        assert encoder.held <= 13_333 + 300 and len(encoder.known) <= 13_333 // bpe.PIECE_COST + 1
    assert len(bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_bytes=40_000).transducer.states) == 1


def test_the_query_answers_from_the_stored_tables(spark, frame, tmp_path):
    frame(EDGE).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(JSON)
    rows = {r["doc_id"]: r for r in token_counts.op10(spark, str(tmp_path)).collect()}
    for i, t in enumerate(EDGE):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_documents_there_and_back(frame):
    path, docs = public_tokenizers.path("byte_bpe_50k.tiktoken"), frame(EDGE)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    assert ids == {i: LIBRARY.encode_ordinary(t or "") for i, t in enumerate(EDGE)}
    back = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(EDGE)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        want, text = ids[r["doc_id"]], EDGE[r["doc_id"]] or ""
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(" ".join(map(str, want)).encode()), sha(text.encode()))
    assert bpe.round_trip(frame([]), path, public_tokenizers.PATTERN).count() == 0


def test_utf8_machine_on_bytes_that_are_not_utf8():
    rnd, odd = random.Random(5), b"a\x80\xbf\xc0\xc3\xa9\xe0\xa0\xed\x9f\xe2\x82\xac\xf0\x90\x9f\xf4\x8f\xf5\xff"
    for _ in range(4000):
        raw = bytes(rnd.choices(odd, k=rnd.randint(0, 14)))
        machine, at, parts = bpe.Utf8Machine(), 0, []
        while at < len(raw):
            k = rnd.randint(1, 4)
            parts.append(machine.push(raw[at : at + k]))
            at += k
            held = machine.tail  # what is held can still become one character, nothing else
            assert len(held) < 4 and (not held or any(held + more in CHARACTERS for more in TAILS))
        parts.append(machine.end())
        assert b"".join(parts) == raw
        assert "".join(p.decode("utf-8", "replace") for p in parts) == raw.decode("utf-8", "replace")


def test_texts_are_split_by_the_standard_library_as_by_regex():
    import regex

    whole, own = regex.compile(public_tokenizers.PATTERN).findall, bpe.splitter(public_tokenizers.PATTERN)
    assert bpe.with_ranges(public_tokenizers.PATTERN) and bpe.with_ranges(r"\d+") is None
    for text in [*texts(3000, 13), *("a" + chr(c) + "1 " + chr(c) * 2 + " \n" for c in range(0x110000) if c < 0x3400 or c % 97 == 0)]:
        assert own(text) == whole(text), ascii(text)


def test_what_is_asked_for_again_stays_when_the_memory_is_full():
    encoder, made = bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_bytes=60_000), []
    encode = encoder.transducer.encode
    encoder.transducer.encode = lambda raw: made.append(raw) or encode(raw)
    for text in ("the " + "".join(p) for p in itertools.product("qzxjkv", repeat=4)):
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)
    assert made.count(b"the") == 1 and len(made) == 6**4 + 1


def test_what_states_take_is_bounded():
    machine = bpe.Transducer(RANKS, cache_bytes=400 * bpe.PAIR_COST)
    for piece in map("".join, itertools.product(["th", "er", "ö", "ing", "q"], repeat=4)):
        assert machine.encode(piece.encode()) == LIBRARY.encode_ordinary(piece)
        assert len(machine.places) <= len(machine.moves) + 1 <= machine.bound + 21 and len(machine.pairs.known) <= 100
