import random
from collections import defaultdict

from grainfold.llm import quality_rules


def test_coverage_decides_where_the_base_rules_do_not(frame):
    rnd = random.Random(2)
    new = lambda n: ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(n)]
    ten, pair = new(10), new(2)
    plain, grams = new(110), [*new(40), *ten, *new(40), *ten, *new(30)]  # 15 % of the words in repeated 10-grams
    one_pair = [w for _ in range(12) for w in (*pair, *new(7))]  # 22 % of the words in one 2-gram
    line = " ".join(new(4))
    lines = "\n".join(x for _ in range(4) for x in (line, " ".join(new(14))))  # 22 % of the words in one line, no repeated 5-gram
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame([*map(" ".join, (plain, grams, one_pair)), lines])).collect()}
    assert [rows[i]["base_failed"] for i in range(4)] == [False] * 4
    assert [rows[i]["kept"] for i in range(4)] == [True, False, False, False]


def test_share_of_one_ngram_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        words = rnd.choices(["a", "bb", "é", "dddd", "e"], k=rnd.randint(1, 30))
        *_, top = quality_rules.measure(" ".join(words).encode())
        for n in (2, 3, 4):
            at = defaultdict(list)
            for i in range(len(words) - n + 1):
                at[tuple(words[i : i + n])].append(i)
            cover = [sum(len(words[j]) for j in {i + k for i in places for k in range(n)}) for places in at.values() if len(places) > 1]
            assert abs(top[n] - max(cover, default=0) / sum(map(len, words))) < 1e-12
