import hashlib
import random

from grainfold.llm import span_dedup


def brute(texts, ids, width):
    least = {}
    for t, i in zip(texts, ids):
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            least[w] = min(least.get(w, i), i)
    for t, i in zip(texts, ids):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def corpus(seed=2):
    rnd = random.Random(seed)
    words = ["the", "é", "sand", "ing", "日本", "x", "on", "tion ", "=", "====="]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice("abcdefg") for _ in range(n))
    passages = [make(rnd.randint(8, 30)) for _ in range(6)]
    texts = ["", None, "short", "a" * 400, "a" * 49, "b" + "a" * 60, "ab" * 100, "\0" * 80]
    for _ in range(60):
        parts = [make(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages)[rnd.randint(0, 20) :], make(rnd.randint(0, 10))]
        texts.append("".join(parts))
    texts += texts[20:30]
    rnd.shuffle(texts)
    return texts


def rows(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_equals_brute_force(frame):
    texts = corpus()
    ids = random.Random(4).sample(range(1000), len(texts))
    want = sorted(brute(texts, ids, 50))
    assert sum(w[2] for w in want) > 3000
    for options in ({}, {"block_bytes": 2000}, {"block_bytes": 3000, "hot": 3, "piece_bytes": 500}):
        assert rows(span_dedup.span_dedup(frame(texts, ids), **options)) == want


def test_edges(frame):
    assert span_dedup.span_dedup(frame([])).count() == 0
    long = "0123456789" * 6 + "tail"
    got = span_dedup.span_dedup(frame([long, long, long], ids=[3, 3, None]), with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept_text"]) for r in got) == [("3", 0, long), ("3", 0, long), ("None", 64, "")]
