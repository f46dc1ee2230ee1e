import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators import embedding, ranking, retrieval, word_scores


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], []))
        out[r["query_id"]].append((r["doc_id"], r["score"]))
    return out


def brute_bm25(asked, docs, k):
    words = {d: t.lower().split() for d, t in docs.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0
    idf = {w: x if x >= 0 else floor for w, x in idf.items()}
    out = {}
    for q, text in asked.items():
        score = {d: round(sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in text.lower().split() if w in ws), 6) + 0.0 for d, ws in words.items()}
        out[q] = [(d, score[d]) for d in sorted(words, key=lambda d: (-score[d], d))[:k]]
    return out


def close(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [d for d, _ in a[q]] == [d for d, _ in b[q]]
        assert all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(a[q], b[q], strict=True))


def test_bm25_equals_brute_force(spark):
    rnd = random.Random(2)
    docs = {i: " ".join(rnd.choices("elm oak ash fir yew the".split(), weights=[1, 2, 3, 4, 5, 30], k=rnd.randint(0, 9))) for i in range(30)}
    asked = {100: "oak ash", 101: "THE the elm", 102: "birch", 103: "", 104: "the"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query string")
    close(lists(retrieval.bm25(queries, frame, 7)), brute_bm25(asked, docs, 7))
    plan = retrieval.bm25(queries, frame, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoopJoin") <= 2 and "CartesianProduct" not in plan  # those with the one row of figures about the corpus
    assert retrieval.bm25(queries, frame.where("false"), 7).count() == 0


def test_bm25_and_vectors_keep_to_their_corpus(spark):
    docs = [("x", i, t) for i, t in enumerate(["oak elm", "elm", "fir"])] + [("y", i, t) for i, t in enumerate(["oak", "oak oak fir"])]
    asked = [("x", 1, "elm fir"), ("y", 2, "oak elm")]
    frame = spark.createDataFrame(docs, "corpus_id string, doc_id bigint, text string")
    queries = spark.createDataFrame(asked, "corpus_id string, query_id bigint, query string")
    want = {q: brute_bm25({q: t}, {d: x for k, d, x in docs if k == c}, 2)[q] for c, q, t in asked}
    close(lists(retrieval.bm25(queries, frame, 2)), want)
    found = lists(retrieval.dense_search(queries, frame, embedding.hashing(), 5))
    assert [d for d, _ in found[1]] == [1, 0, 2] or len(found[1]) == 3
    assert len(found[2]) == 2


def test_overlap_equals_brute_force(spark):
    rnd = random.Random(4)
    docs = {i: " ".join(rnd.choices(["a1", "b2", "c3", "d4", "E5"], k=rnd.randint(0, 5))) for i in range(25)}
    asked = {1: "a1 e5", 2: "none", 3: ""}
    frame = spark.createDataFrame([*docs.items(), (99, None)], "doc_id bigint, text string")
    got = lists(retrieval.overlap_search(spark.createDataFrame(list(asked.items()), "query_id bigint, query string"), frame, 6))
    sets = {i: set(t.lower().split()) for i, t in docs.items()} | {99: set()}
    for q, t in asked.items():
        score = {d: round(len(s & set(t.split())) / math.sqrt(max(1, len(s))), 6) for d, s in sets.items()}
        assert got[q] == [(d, score[d]) for d in sorted(sets, key=lambda d: (-score[d], d))[:6]]


def test_words_and_pairs_of_documents_and_queries_are_not_shuffled(spark):
    """Before, each word of each document that a query asks for was, and in BM25 each word of each document."""
    docs = spark.createDataFrame([(i, f"elm w{i % 7}") for i in range(300)], "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(q, f"elm w{q}") for q in range(5)], "query_id bigint, query string")
    for search in (retrieval.overlap_search, retrieval.bm25):
        found = search(queries, docs, 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and "doc_id, " not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line)
        assert [[d for d, _ in lists(found)[q]] for q in range(5)] == [[q, q + 7, q + 14, q + 21] for q in range(5)]


def test_words_of_a_vocabulary_leave_their_bucket_as_sums(spark, monkeypatch):
    """Before, a row of each word of each corpus was written and read three times."""
    docs = spark.createDataFrame([(i % 2, i, f"elm w{i} v{i} x{i % 3}") for i in range(3000)], "corpus_id bigint, doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(c, c, "ELM w7 w8 nothing") for c in range(2)], "corpus_id bigint, query_id bigint, query string")
    rows, stash = {}, retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, name: rows.setdefault(name, stash(df, name)))
    retrieval.bm25(queries, docs, 3)
    assert rows["vocabulary"].count() <= 2 * (1 + 4 + 3 * word_scores.BUCKETS)  # the corpus, what it is asked for, three numbers of documents


def test_counts_of_words_equal_brute_force():
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "y", None]), " ".join(rnd.choices(["elm", "oak", "\u00e9", "fir", "a" * 40, *(f"w{i}" for i in range(300))], k=rnd.randint(0, 30)))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["corpus_id", "text"])
    corpus, corpora = word_scores.codes_of(pa.array(["x", "x", "y"]))
    terms, none = pa.array(["elm", "nothing", "oak"]), np.zeros(3, np.int64)
    asked = word_scores.packed(word_scores.hashes(terms, 8), corpora, corpus, terms, none, none, True)
    parts = [word_scores.counted([batch.slice(a, 30), batch.slice(a + 30, 20)], word_scores.split_words, 8) for a in range(0, 200, 50)]
    whole = pa.Table.from_batches([*parts, asked])
    buckets = [whole.filter(pc.equal(whole["bucket"], b)) for b in range(8)]
    found = [r for bucket in buckets if len(bucket) for r in word_scores.added_up(bucket).to_pylist()]
    want = []
    for c in ("x", "y", None):
        texts = [t.split() for k, t in rows if k == c]
        df = Counter(w for t in texts for w in set(t))
        want.append((c, "documents", None, len(texts), sum(map(len, texts))))
        want += [(c, "asked", w, df[w], 1) for w in {"x": ["elm"], "y": ["oak"]}.get(c, [])]
        want += [(c, "terms", None, d, n) for d, n in Counter(df.values()).items()]
    got = Counter()
    for r in found:  # buckets add up
        got[r["corpus_id"], r["kind"], r["term"], r["df"] if r["kind"] == "terms" else 0] += r["n"]
    assert got == Counter({(c, k, w, d if k == "terms" else 0): n for c, k, w, d, n in want})
    assert {(r["corpus_id"], r["kind"], r["term"], r["df"]) for r in found if r["kind"] != "terms"} == {(c, k, w, d) for c, k, w, d, _ in want if k != "terms"}


def test_words_are_those_of_columns(spark):
    edges = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (chr(c).isspace() or c < 256 or c % 997 == 0 or 0x2000 <= c < 0x2070)]
    texts = [f"{c}a{c}{c} b{c}" for c in edges] + ["", " ", "x" * 5000, "one  two\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    want = [r["w"] for r in frame.select("i", T.words(F.col("t")).alias("w")).orderBy("i").collect()]
    words, sizes = word_scores.split_words(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [words.slice(e - n, n).to_pylist() for n, e in zip(sizes, ends, strict=True)] == want


def test_scores_of_rare_and_common_terms_equal_the_product(monkeypatch):
    monkeypatch.setattr(word_scores, "CELLS", 64)  # rare terms in many parts
    rnd = np.random.default_rng(3)
    full = np.where(rnd.random((40, 60)) < [[0.9]] * 5 + [[0.04]] * 35, rnd.normal(size=(40, 60)), 0.0)  # terms x queries
    asked = pa.array([{"query_id": int(q), "term": f"t{t}", "weight": full[t, q]} for t, q in np.argwhere(full)])
    made = word_scores.Weights(asked)
    names, ids = made.terms.to_pylist(), made.queries.to_pylist()
    share = np.where(rnd.random((25, len(names))) < 0.3, rnd.random((25, len(names))), 0.0)
    doc, term = np.nonzero(share)
    want = share @ full[[int(n[1:]) for n in names]][:, ids]
    assert 0 < made.common < len(names) and np.allclose(made.scores(25, doc, term, share[doc, term]), want)
    assert np.allclose(made.scores(25, doc[:0], term[:0], share[:0, 0]), 0)
    for q in range(3):
        assert (made.met(25, doc, term, q) == ((share > 0) @ (full[[int(n[1:]) for n in names]][:, ids[q]] != 0))).all()


def test_best_of_leaves_out_what_is_no_hit():
    scores = np.array([[1.0, 3.0, 3.0, -np.inf], [-np.inf] * 4, [-1.0, -np.inf, 0.0, 0.0]])
    assert [x.tolist() for x in word_scores.best_of(scores, 3)] == [[0, 0, 0, 2, 2, 2], [1, 2, 0, 2, 3, 0]]


def test_vector_search_equals_brute_force_and_breaks_ties_by_place(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (90, 4)).astype(float)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(6)], "query_id bigint, query array<float>")
    got = lists(retrieval.vector_search(queries, frame, 8))
    for i in range(6):
        s = v @ v[i]
        assert got[i] == [(d, s[d]) for d in sorted(range(90), key=lambda d: (-s[d], d))[:8]]
    assert retrieval.vector_search(queries, frame.limit(3), 8).count() == 18
    assert retrieval.vector_search(queries, frame.where("false"), 8).count() == 0
    with pytest.raises(ValueError):
        retrieval.vector_search(queries, frame, 0)


def test_index_checks_dimensions(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, embedding array<double>")
    b = spark.createDataFrame([(2, [0.0, 1.0, 0.0])], "doc_id bigint, embedding array<double>")
    assert retrieval.added(retrieval.added(None, a, 2), a, 2).count() == 2
    with pytest.raises(Exception, match="a vector of dimension 2 is needed"):
        retrieval.added(a, b, 2).collect()


def test_fusion(spark):
    rows = lambda *ids: spark.createDataFrame([(1, d, 0.5, i) for i, d in enumerate(ids)], "query_id bigint, doc_id bigint, score double, rank int")
    got = lists(retrieval.fuse(rows(5, 6, 7), rows(7, 8), 3))[1]
    assert [d for d, _ in got] == [7, 5, 6] and abs(got[0][1] - (1 / 62 + 1 / 60)) < 1e-8
    assert [d for d, _ in lists(retrieval.fuse(rows(5, 6), rows(8), 3, w_sparse=0))[1]] == [5, 6]


def test_diversify(spark):
    rows = [(1, 10, 1.0, 0, [1.0, 0.0]), (1, 11, 0.9, 1, [1.0, 0.0]), (1, 12, 0.5, 2, [0.0, 1.0]), (2, 10, 0.1, 0, [0.0, 0.0])]
    hits = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, rank int, embedding array<double>")
    order = lambda t: [d for d, _ in lists(retrieval.diversify(hits, t))[1]]
    assert (order(1.0), order(0.3)) == ([10, 11, 12], [10, 12, 11])
    assert lists(retrieval.diversify(hits))[2] == [(10, 0.1)]
    with pytest.raises(ValueError):
        retrieval.diversify(hits, 1.2)


def test_redundancy(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0])]
    hits = spark.createDataFrame(rows, "query_id bigint, rank int, embedding array<double>")
    r = retrieval.redundancy(hits, top_n=2)
    assert tuple(r.first()) == (1.0, 1.0, round(1 / 3, 6), 1.0, "HIGH")
    assert retrieval.pairwise_similarity(hits).where("query_id = 2").first()["mean"] is None


def test_repacking(spark):
    rows = spark.range(5).select(F.col("id").cast("int").alias("p"))
    placed = lambda kind: [p for p, _ in sorted(((r["p"], r["q"]) for r in rows.select("p", ranking.repacked(F.col("p"), F.lit(5), kind).alias("q")).collect()), key=lambda x: x[1])]
    assert (placed("forward"), placed("reverse"), placed("sides")) == ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [0, 2, 4, 3, 1])


def test_rerankers(spark):
    class Lengths:  # local, so that it travels to the workers by value
        def __init__(self, model):
            assert model == "any"

        def predict(self, pairs, batch_size, show_progress_bar):
            return [len(q) + len(t) % 5 for q, t in pairs]

    rows = [(1, i, 1.0 - i / 10, i, "red fox", t) for i, t in enumerate(["a", "the red fox", "fox", "bbbb", "red fox"])]
    hits = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, rank int, query string, text string")
    ids = lambda made: [d for d, _ in lists(made)[1]]
    assert ids(ranking.keep_order()(hits, 2)) == [0, 1]
    assert ids(ranking.lexical_reranker()(hits, 4)) == [4, 1, 2, 0]
    assert ids(ranking.cross_encoder("any", load=Lengths)(hits, 5)) == [3, 2, 4, 0, 1]
    assert ids(ranking.bge_large("any", load=Lengths)(hits, 1)) == [3]


def test_query_classes(one):
    kind = lambda q: tuple(one(ranking.needs_retrieval(F.col("q")), q=q))
    assert (kind(" "), kind("çé dü"), kind("çé dü is"), kind("what do they mean"), kind("what is due when")) == ((False, 1.0), (False, 0.8), (True, 0.9), (False, 0.7), (True, 0.9))
    assert kind("bye for now my friend") == (False, 0.7) and kind("Good morning to you all") == (False, 0.7) and kind("who are you really") == (True, 0.9)
    assert kind(None) == (False, 1.0)
    assert one(ranking.heuristic(1, ["zzz"])(F.col("q")), q="hello")["needs_retrieval"]
    assert tuple(one(ranking.always()(F.col("q")), q="")) == (True, 1.0)


def test_compression(spark):
    text = "Cats sleep. Dogs bark loudly. Birds sing. Dogs bark loudly."
    docs = spark.createDataFrame([(1, text, "dogs and birds"), (2, "One sentence only", "dogs"), (3, text, "?"), (4, "", "x"), (5, None, "x"), (6, text, None)], "doc_id bigint, text string, query string")
    got = {r["doc_id"]: r["text"] for r in ranking.lexical_summarizer(0.5)(docs).collect()}
    assert got == {1: "Dogs bark loudly. Birds sing.", 2: "One sentence only", 3: text, 4: "", 5: None, 6: text}
    got = {r["doc_id"]: r["text"] for r in ranking.embedding_summarizer(ratio=0.3)(docs).collect()}
    assert got[1] == "Dogs bark loudly. Dogs bark loudly." and got[2] == "One sentence only" and got[4] == ""
    for wrong in ({"ratio": 0}, {"ratio": 1.1}, {"min_keep": 0}):
        with pytest.raises(ValueError):
            ranking.lexical_summarizer(**wrong)


def test_prompts(one):
    chunks = F.array(F.lit("a"), F.lit("b"))
    assert one(ranking.prompt(chunks, F.lit("Q?"))) == "Context:\n[1] a\n[2] b\n\nQuestion: Q?\nAnswer:"
    assert one(ranking.context(chunks)) == "a\nb"
    assert one(ranking.prompt(F.array().cast("array<string>"), F.lit(None))) == "Context:\n\n\nQuestion: \nAnswer:"
    assert len(set(ranking.INSTRUCTIONS.values())) == 6
