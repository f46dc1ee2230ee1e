import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from grainfold.operators import retrieval
from grainfold.operators import embedding
from grainfold.operators.postings import PostingsIndex
from grainfold.operators.vector_index import VectorIndex, matrix_blocks


def brute_bm25(texts, query, k):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    scores = {}
    for i, ws in words.items():
        tf, total = Counter(ws), 0.0
        for w, q in Counter(query.lower().split()).items():
            if tf[w]:
                total += q * (idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
        scores[i] = round(total, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def corpus(seed, n=120):
    rnd = random.Random(seed)
    return {i: " ".join(rnd.choices(["the", "of", "rare", *[f"w{j}" for j in range(60)]], [30, 20, 0.3, *[1] * 60], k=rnd.randint(0, 40))) for i in range(n)} | {n: None, n + 1: "  "}


@pytest.mark.parametrize("slices", [1, 4, 1000])
def test_stored_postings_rank_like_brute_force(spark, tmp_path, slices):
    texts = corpus(slices)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = PostingsIndex.build(docs, f"{tmp_path}/index", buckets=4, slice_docs=slices)
    asked = ["rare", "the w1 w1", "of W2 w3 unknown", "unknown", "", "rare w5 the of"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    again = PostingsIndex(spark, f"{tmp_path}/index")  # as another session would open it
    for made in (index, again):
        found = {}
        for r in retrieval.bm25(queries, made, 7).orderBy("rank").collect():
            found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        for i, q in enumerate(asked):
            assert found[i] == brute_bm25(texts, q, 7), q


def test_blocks_that_cannot_hold_the_best_are_left_out(spark, tmp_path):
    texts = {i: "common " + "filler " * 20 for i in range(300)} | {i: "common rare rare rare" for i in range(300, 310)}
    index = PostingsIndex.build(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), f"{tmp_path}/index", slice_docs=2)
    weights = spark.createDataFrame([(0, 0, "common", 0.1), (0, 0, "rare", 5.0)], "corpus_id int, query_id int, term string, weight double")
    tops = index.blocks.join(weights, ["corpus_id", "term"]).select("query_id", "term", "slice", "weight", "tops")
    kept, every = index.live(tops, 5).count(), tops.select("slice").distinct().count()
    assert 5 <= kept <= 10 < every
    negative = tops.withColumn("weight", -tops["weight"])
    assert index.live(negative, 5).count() == every
    assert index.blocks.where("size(postings) != n OR postings[0].share != tops[0]").count() == 0


def test_only_asked_buckets_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(200)], "doc_id long, text string")
    index = PostingsIndex.build(docs, f"{tmp_path}/index", buckets=16)
    asked = spark.createDataFrame([(0, 0, "w7")], "corpus_id int, query_id int, term string")
    read = index.asked_blocks(asked).collect()
    assert len({r["bucket"] for r in read}) == 1 and "w7" in {r["term"] for r in read}
    assert re.search(r"PartitionFilters: \[[^]]*bucket", index.asked_blocks(asked)._jdf.queryExecution().executedPlan().toString())
    assert PostingsIndex.build(docs.limit(0), f"{tmp_path}/empty").scores(spark.createDataFrame([(1, "w7")], "query_id int, query string"), 3).count() == 0


def test_stored_vectors_by_corpus_equal_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(4)
    rows = [(int(rnd.integers(0, 4)) if i % 9 else 7, i, rnd.normal(size=5).round(3).tolist()) for i in range(400)]
    rows += [(0, 400, rows[0][2]), (0, None, rows[0][2]), (1, 401, None)]
    path, schema = f"{tmp_path}/vectors", "corpus_id int, doc_id long, embedding array<double>"
    VectorIndex.add(spark.createDataFrame(rows[:250], schema), path, folders=8)
    index = VectorIndex.add(spark.createDataFrame(rows[250:], schema), path, folders=8)
    stored = [r for r in rows if r[1] is not None and r[2] is not None]
    assert index.size() == len(stored)
    queries = [(c, 10 * c + j, rnd.normal(size=5).round(3).tolist()) for c in (0, 1, 7, 9) for j in range(3)]
    found = {}
    for r in retrieval.vector_search(spark.createDataFrame(queries, "corpus_id int, query_id long, query array<double>"), index, 4).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for c, q, v in queries:
        best = sorted(((round(float(np.dot(v, e)), 6), i) for k, i, e in stored if k == c), key=lambda x: (-x[0], x[1]))[:4]
        assert [i for _, i in best] == [i for i, _ in found.get(q, [])], (c, q)
    assert re.search(r"PartitionFilters: \[[^]]*folder", index.of(spark.createDataFrame([(7,)], "corpus_id int"))._jdf.queryExecution().executedPlan().toString())
    wanted = spark.createDataFrame([(7, 9), (7, 18), (0, 400), (1, 9)], "corpus_id int, doc_id long")
    assert {(r["corpus_id"], r["doc_id"]): r["embedding"] for r in index.vectors(wanted).collect()} == {(c, i): e for c, i, e in stored if (c, i) in {(7, 9), (7, 18), (0, 400)}}


def test_blocks_keep_to_one_corpus_and_one_dimension(spark):
    rows = spark.createDataFrame([(i % 3, i, [float(i)]) for i in range(20)], "corpus_id int, doc_id long, embedding array<double>")
    made = matrix_blocks(rows, "doc_id", "embedding", size=4).collect()
    assert sorted(k for r in made for k in r["keys"]) == list(range(20)) and all(r["n"] == len(r["keys"]) <= 4 and len({k % 3 for k in r["keys"]}) == 1 for r in made)
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id int, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="several dimensions"):
        matrix_blocks(uneven, "doc_id", "embedding").collect()


def test_texts_become_blocks_where_they_are(spark):
    """Before, vectors of texts went through the JVM on their way into blocks."""
    model = embedding.hashing(8)
    docs = spark.createDataFrame([(2, "b a"), (1, None), (3, "c"), (None, "d")], "doc_id long, text string").coalesce(1)
    made = matrix_blocks(docs, "doc_id", "text", load=model.load).collect()
    want = embedding.hashing_encode(["", "b a", "c"], 8)
    assert [r["keys"] for r in made] == [[1, 2, 3]] and np.allclose(np.frombuffer(made[0]["matrix"]).reshape(3, 8), want)
