import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainfold.llm import exact_dedup, line_dedup, packing, quality_classifier, quality_rules

JSON = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [None, "", "  \n", "a", "same  text\nhere", "same text here", "x <|endoftext|> é 日本", "word " * 3000]


@pytest.mark.parametrize("seed", range(8))
def test_packing_is_gapless_and_near_the_bound(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice([rnd.randint(1, 64), rnd.randint(20, 40)]) for _ in range(rnd.randint(1, 400)))
    patterns = packing.pack(counts, 64)
    used = Counter()
    for times, lengths in patterns:
        assert times > 0 and sum(lengths) <= 64
        for w in lengths:
            used[w] += times
    assert used == counts
    bins = sum(t for t, _ in patterns)
    assert bins <= math.ceil(11 / 9 * max(math.ceil(sum(w * n for w, n in counts.items()) / 64), sum(n for w, n in counts.items() if w > 32))) + 1


def test_packing_of_documents(frame):
    rows = packing.best_fit_packing(frame(EDGE + EDGE[:2]), JSON).collect()
    library = Tokenizer.from_file(JSON)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(EDGE + EDGE[:2])}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        import zlib

        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] <= 1024 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.best_fit_packing(frame([]), JSON).count() == 0


def test_quality_rules_equal_brute_force(frame):
    texts = [*EDGE, "a b c d e f a b c d e x y\na b c\n a b c\na b c", "#tag $5 |x|\n" * 4, "é" * 30]
    for r in quality_rules.quality_rules(frame(texts)).collect():
        t = (texts[r["doc_id"]] or "").encode()
        w = t.split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split(b"\n") if x.split()]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(len(x.decode()) for x in w))
        assert (r["n_repeat_words"], r["n_dup_lines"]) == (len(inside), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in b"#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_exact_dedup_and_a_second_batch(spark, frame):
    index = exact_dedup.fresh_index(spark)
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(EDGE), index).collect()}
    assert (rows[5]["keep_id"], rows[5]["kept"], rows[4]["kept"], rows[5]["group_size"]) == (4, False, True, 2)
    assert rows[1]["keep_id"] == 0 and rows[2]["keep_id"] == 2
    for _ in range(2):  # a batch that is admitted again changes nothing
        later = {r["doc_id"]: (r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(["new", "same text here"], ids=[100, 3]), index).collect()}
        assert later == {100: (True, 1), 3: (False, 1)} and index.rows().count() == 7
    index.drop()
    assert not index.tables()
    assert exact_dedup.once(frame([]), 2).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_exact_dedup_in_batches_equals_brute_force(frame, batches):
    rnd = random.Random(batches)
    texts = [rnd.choice([None, "", " ", "a b", "a  b", "a\tb", "c", "long " * 2000]) for _ in range(60)] + [f"own {i}" for i in range(40)]
    ids = [rnd.choice([None, *range(40)]) for _ in texts]
    got = sorted(((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.once(frame(texts, ids), batches).collect()), key=repr)
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    want = []
    for i, p in zip(ids, plain):
        same = [j for j, q in zip(ids, plain) if p == q]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, hashlib.sha256(p.encode()).hexdigest(), keep, len(same), i == keep))
    assert got == sorted(want, key=repr)


def test_the_index_is_neither_shuffled_nor_sorted(spark, frame):
    """Each run stands below the merge join as it is scanned; only the new side has an exchange and a sort."""
    index = exact_dedup.fresh_index(spark)
    for i in range(2):
        index.admit(exact_dedup.digests(frame([*EDGE, f"more {i}"])))
    new = exact_dedup.digests(frame(EDGE)).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    for at in index.runs():
        new = new.join(index.run(at).select("digest").hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert len(index.runs()) == 2 and plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    index.drop()


def test_runs_are_merged(spark, frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUNS", 3)
    index = exact_dedup.fresh_index(spark)
    for i in range(8):
        index.admit(exact_dedup.digests(frame([f"text {i}", f"text {i // 2}", None], ids=[10 * i, 10 * i + 1, 5])))
        assert len(index.runs()) <= 3 and len({g for g, _ in index.tables()}) == 1
    rows = {r["digest"]: r["keep_id"] for r in index.rows().collect()}
    assert len(rows) == index.rows().count() == 9
    found = {r["digest"]: r["keep_id"] for r in index.found(exact_dedup.digests(frame(["text 3", "none", ""])).select("digest")).collect()}
    assert sorted(found.values()) == [5, 30]
    index.drop()
    assert not index.tables()


def test_line_dedup_equals_brute_force(frame):
    rnd = random.Random(3)
    pool = ["".join(rnd.choices("abc é", k=rnd.randint(18, 40))) for _ in range(12)]

    def edit(s):
        k = rnd.randrange(len(s))
        return rnd.choice([s, s[:k] + s[k + 1 :], s[:k] + "z" + s[k:], s[:k] + "q" + s[k + 1 :], s[:k] + "qq" + s[k + 2 :]])

    texts = [None, "", *("\n".join(edit(rnd.choice(pool)) for _ in range(rnd.randint(1, 4))) for _ in range(25))]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    every = [(i, k, line) for i, t in enumerate(texts) if t is not None for k, line in enumerate(t.split("\n"))]
    want = {i: [] for i, t in enumerate(texts) if t is not None}
    for i, k, line in every:
        if len(line) < 20 or not any((j, m) < (i, k) and len(o) >= 20 and near(line, o) for j, m, o in every):
            want[i].append(line)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(texts)).collect()}
    assert got[0] is None
    assert {i: got[i] for i in want} == {i: "\n".join(x) for i, x in want.items()}


def test_classifier_learns_and_keeps_without_labels(spark, frame):
    rnd = random.Random(1)
    good = [" ".join(rnd.choices(["sun", "moon", "tree", "river", "stone"], k=30)) for _ in range(150)]
    bad = [" ".join(rnd.choices(["sun%%%", "moon&&&", "spam", "river"], k=30)) for _ in range(150)]
    docs = frame(good + bad + EDGE)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 3], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, model).collect()}
    assert sum(kept[i] for i in range(150)) >= 147 and sum(kept[i] for i in range(150, 300)) <= 3
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    assert quality_classifier.fit(docs, labels.where("false")) is None
    assert quality_classifier.score(docs, None).where(~F.col("kept")).count() == 0


def test_line_dedup_of_long_lines_repeated_and_null_ids(frame):
    rnd = random.Random(8)
    base = "".join(rnd.choices("abcdé ", k=700))
    texts = [base, base[:5] + base[6:], base[:350] + "z" + base[350:], base[:690] + "q" + base[691:], base[:100] + "zz" + base[100:], base + "\nthe only line of this version"]
    ids = [1, 2, 3, 4, 5, 1]
    got = [(r["doc_id"], r["text"], r["n_near"]) for r in line_dedup.line_dedup(frame(texts, ids)).collect()]
    want = [(1, base, 0), (2, "", 1), (3, "", 1), (4, "", 1), (5, texts[4], 0), (1, texts[5], 0)]
    assert sorted(got) == sorted(want)  # 5 is two edits away from every other
    got = {(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(frame([base, base], [None, -7])).collect()}
    assert got == {(None, base), (-7, "")}
