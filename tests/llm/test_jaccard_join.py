import random

from grainfold.llm import jaccard_join


def brute(texts, ids):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: (len(sets[i]), min(groups[root(i)])) for i in range(len(texts))}


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rnd.choices(words, k=14))
    texts = ["", None, "  \n ", "one", "ONE", "one two", "a b c d", "a b c d e", "A b  c\td e"]
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randint(5, 120))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                copy = copy[rnd.randint(0, 8) :]
            base = copy if rnd.random() < 0.4 and len(copy) > 4 else base
            texts.append((line + "\n" if rnd.random() < 0.3 else "") + " ".join(copy))
    rnd.shuffle(texts)
    return texts


def test_components_equal_brute_force(frame):
    texts = corpus()
    ids = random.Random(1).sample(range(10_000), len(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(texts, ids)).collect()}
    want = brute(texts, ids)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 20


def test_edges(frame):
    assert jaccard_join.jaccard_components(frame([])).count() == 0
    rows = jaccard_join.jaccard_components(frame(["a b c d e f"] * 3, ids=[4, 4, None])).collect()
    assert sorted((r["component_id"] for r in rows), key=str) == [4, 4, 4]


def test_pairs_of_a_group_of_near_copies_grow_with_its_size_and_not_its_square(frame):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]

    def copy(edits):
        words = list(base)
        for i in rnd.sample(range(120), edits):
            words[i] = f"x{rnd.random()}"
        return " ".join(words)

    texts = [copy(edits) for edits in (1, 2, 3) for _ in range(200)]  # those of three are near few others, but all are connected
    report: list = []
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(texts), report=report).collect()}
    assert got == brute(texts, list(range(len(texts))))
    assert len({c for _, c in got.values()}) == 1
    assert sum(before for before, _ in report) < 40 * len(texts), report
