import math
from collections import Counter

import pytest

from grainfold.llm import lm_scores


def brute(texts, order):
    docs = [(t or "").split() for t in texts]
    grams = lambda d, n: [tuple(d[i - n + 1 : i + 1]) for i in range(n - 1, len(d))]
    every = [Counter(g for d in docs for g in grams(d, n)) for n in range(1, order + 1)]
    total = sum(map(len, docs))
    for d in docs:
        own = [Counter(grams(d, n)) for n in range(1, order + 1)]
        rest = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]

        def s(g):
            if len(g) == 1:
                return max(rest(g), 1) / max(total - len(d), 1)
            return rest(g) / max(rest(g[:-1]), rest(g)) if rest(g) > 0 else 0.4 * s(g[1:])

        longest = [tuple(d[max(0, i - order + 1) : i + 1]) for i in range(len(d))]
        backed = sum(len(g) > 1 and rest(g) == 0 for g in longest)
        yield len(d), backed, round(sum(math.log10(s(g)) for g in longest), 6)


TEXTS = ["the cat sat on the mat", "the cat ate", None, "", "the dog sat on the cat " * 30, "the cat sat on the mat", "one", "zz yy xx", "a b\na b\tc", "on the mat the cat sat on"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(frame, order):
    for block in (10, 60, 10**6) if order == 3 else (60,):
        rows = {r["doc_id"]: r for r in lm_scores.lm_scores(frame(TEXTS), block_bytes=block, order=order).collect()}
        for i, (n, backed, total) in enumerate(brute(TEXTS, order)):
            assert (rows[i]["n_words"], rows[i]["n_backoff"]) == (n, backed)
            assert abs(rows[i]["log10_score"] - total) < 1e-5
            assert (rows[i]["mean_log10"] is None) == (n == 0)


def test_order_of_words_counts(frame):
    near = "we saw a red fox near the old mill"
    rows = lm_scores.lm_scores(frame([near, near, "we saw the old fox near a red mill"])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_backoff"] == 0 and by[2]["n_backoff"] > 4 and by[0]["mean_log10"] > by[2]["mean_log10"]


def test_edges(spark, frame):
    assert lm_scores.lm_scores(frame([])).count() == 0
    only = lm_scores.lm_scores(frame(["a b"])).collect()[0]
    assert only["n_backoff"] == 1 and only["log10_score"] < 0
    assert lm_scores.lm_scores(frame(["x y", "x y"], ids=[1, 1])).count() == 2
    docs = frame(["a long one " * 50_000, "x", None], ids=[None, 2, 3]).withColumnsRenamed({"lang": "phase", "source": "slice", "n_chars": "totals"})
    assert sorted(r["n_words"] for r in lm_scores.lm_scores(docs).collect()) == [0, 1, 150_000]
    with pytest.raises(ValueError):
        lm_scores.lm_scores(docs, order=0)
