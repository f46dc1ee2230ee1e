import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from grainfold.llm import chunk_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["the", "Er", "on", "é", "ß", "in", "9", "'s", "-"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus():
    rnd = random.Random(3)
    shared = [prose(rnd, 400) for _ in range(3)]
    texts = [prose(rnd, rnd.randint(0, 60)) + rnd.choice([" ", "", "x", "<|endoftext|>"]) + rnd.choice(shared) + rnd.choice(["", "y", "\n\n"]) + prose(rnd, 30) for _ in range(40)]
    edge = [None, "", "  \n\t", "a", "Á é ΣΑΣ Σ", "<|startoftext|><|endoftext|> <|endoftext|", "x" * 3000, "x" * 3000, "don't I'LL we've 'd '", "日本語 🎉🎉 ١٢٣", "ﬁ Ⅷ ½", "ab" * 900 + " " + "cd" * 900, "a b c\x1cd\x85e"]
    return [*texts, *texts[:5], *edge, *edge[:2]]


def test_digests_equal_the_library(frame):
    texts = corpus()
    rows = chunk_bpe.encoded(frame(texts), PATH, True).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == library(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert chunk_bpe.encoded(frame([]), PATH, True).count() == 0


def test_ids_and_decoded_text(frame):
    texts = corpus()
    ids = chunk_bpe.encode_documents(frame(texts, [None, *range(1, len(texts))]), PATH)
    for r in ids.collect():
        assert np.frombuffer(r["ids"], "<u2").tolist() == LIBRARY.encode(texts[r["doc_id"] or 0] or "", add_special_tokens=False).ids
    for r in chunk_bpe.decode_documents(ids, PATH).collect():
        text = texts[r["doc_id"] or 0] or ""
        assert r["text"] == LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once_and_a_full_filter_changes_nothing(frame, spark):
    texts = corpus()
    docs = frame(texts)
    plan = chunk_bpe.planned(docs, spark.sparkContext.broadcast(chunk_bpe.shared_filter(chunk_bpe.hashes(docs, PATH, 1 << 20, "doc_id", "text"))), PATH, 1 << 20, True, "doc_id", "text")
    kinds = {r["kind"]: r["count"] for r in plan.groupBy("kind").count().collect()}
    assert kinds["open"] >= 40 and kinds["core"] and kinds["done"]
    everything = np.full(chunk_bpe.FILTER_BITS // 64, -1, np.int64)
    words = chunk_bpe.tokenizer(PATH, 1 << 20)
    for text in texts:
        gaps, refs, cores = chunk_bpe.stretches(words, everything, text or "")
        ids = gaps[0] + b"".join(words.encode(cores[r].decode()) + g for r, g in zip(refs, gaps[1:], strict=True))
        assert np.frombuffer(ids, "<u2").tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_heap_and_list_merge_alike():
    words, rnd = chunk_bpe.tokenizer(PATH, 1 << 20).words, random.Random(5)
    for _ in range(300):
        word = "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 120))).encode()
        ids = [words.inner[b] for b in word]
        ids[-1] = words.final[word[-1]]
        assert words.by_list(list(ids)) == words.by_heap(list(ids))


def test_cuts_follow_the_content():
    rnd = random.Random(7)
    passage = prose(rnd, 3000)
    first, second = ({d for _, d in chunk_bpe.chunks(head + passage)} for head in ("", prose(rnd, 50)))
    assert len(first & second) > 0.8 * len(first)
    raw = passage.encode()
    assert b"".join(c for c, _ in chunk_bpe.chunks(passage)) == raw and all(c.decode() for c, _ in chunk_bpe.chunks(passage))
