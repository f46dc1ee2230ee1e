import hashlib
import random
import zlib

import numpy as np
import pytest

from grainfold.llm import periodic_runs


def brute(words, least=6, times=4):
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(least, times * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.add((i, len(run), q))
            i = j + 1
    return sorted(found)


def texts(seed):
    rnd = random.Random(seed)
    for _ in range(600):
        words = [rnd.randint(0, rnd.choice([1, 2, 3, 40])) for _ in range(rnd.randint(0, 100))]
        if len(words) > 12 and rnd.random() < 0.7:
            q, a = rnd.randint(1, len(words) // 4), rnd.randint(0, len(words) // 2)
            for i in range(a + q, rnd.randint(a, len(words))):
                words[i] = words[i - q]
        yield words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    for words in texts(seed):
        assert periodic_runs.runs_of(np.array(words, np.int64)) == brute(words), words
        assert periodic_runs.runs_of(np.array(words, np.int64), 3, 3) == brute(words, 3, 3), words


def test_a_long_periodic_text_takes_linear_work():
    words = np.array(([0] * 6 + [1]) * 20_000, np.int64)
    runs = periodic_runs.runs_of(words)
    assert (0, len(words), 7) in runs and len(runs) == 20_001


def expected(doc_id, text):
    words = periodic_runs_words(doc_id, text)
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def periodic_runs_words(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_the_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, " ".join("abcdefgh"[rnd.randint(0, 7)] for _ in range(rnd.randint(0, 200)))) for i in range(150)]
    rows += [(7, rows[7][1]), (200, None), (201, ""), (202, " \n\t"), (203, "x " * 5000), (204, "a\x1cb a b c"), (None, "y y y y y y y y z"), (205, "q\x0br\x0cs")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op12(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_the_operator_keeps_texts_as_they_are(frame):
    made = {r["doc_id"]: r for r in periodic_runs.periodic_runs(frame(["a b a b a b a b c", None], [1, None])).collect()}
    assert [tuple(r) for r in made[1]["runs"]] == [(0, 8, 2)] and made[1]["collapsed"] == "a b c" and made[1]["n_words"] == 9
    assert made[None]["runs"] == [] and made[None]["collapsed"] == ""
    assert periodic_runs.periodic_runs(frame([])).count() == 0
