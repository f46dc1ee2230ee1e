import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from grainfold.llm import quality_classifier, span_dedup


def words(rnd, n):
    return ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]


def rows(frame):
    rnd = random.Random(7)
    a, b, c, d = (words(rnd, 60) for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "other"])
    join = " ".join
    texts = [join(a), join(a), join(a), join(b), join(b), near(a), join(c), near(b), join(d), near(d), None, "", "  ", " \n"]
    ids = [1, 1, 2, None, None, 3, 3, 4, 5, 5, 6, 7, None, None]
    return texts, ids, frame(texts, ids)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_copies_leave_one_row_a_text(spark, frame):
    texts, ids, docs = rows(frame)
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.schema == docs.schema
    got, best = pairs(out), {}
    for i, t in zip(ids, texts):
        key = " ".join((t or "").split()) if (t or "").split() else " " * bool(t)
        best[key] = min(best.get(key, (True, 0)), (i is None, i or 0))
    want = Counter((None if last else i, key) for key, (last, i) in best.items())
    assert Counter((i, " ".join((t or "").split()) if (t or "").split() else " " * bool(t)) for i, t in got) == want
    assert corpus_pipeline.drop_copies(spark, frame([]), "").count() == 0


def test_near_copies_leave_one_row_a_component(spark, frame):
    texts, ids, docs = rows(frame)
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, ""), "")
    assert out.schema == docs.schema
    got = [(i, t) for i, t in pairs(out) if (t or "").strip()]
    assert {(1, texts[0]), (3, texts[6]), (4, texts[7])} < set(got) and len(got) == 4  # near(a) has doc_id 3, which stays for another text
    assert [i for i, _ in got].count(5) == 1
    assert corpus_pipeline.drop_near_copies(spark, frame([]), "").count() == 0


def test_passages_equal_the_operator_and_carry_columns(spark, frame):
    rnd = random.Random(9)
    shared = " ".join(words(rnd, 80))
    docs = frame([shared + " one", "two " + shared + " three", None]).withColumn("source", F.concat(F.lit("s"), "doc_id")).withColumn("n_chars", F.lit(1).cast("bigint"))
    out = {r["doc_id"]: r for r in corpus_pipeline.drop_passages(spark, docs, "").collect()}
    want = {r["doc_id"]: r["kept_text"] for r in span_dedup.span_dedup(docs, with_text=True).collect()}
    assert {i: r["text"] for i, r in out.items()} == want and shared not in want[1]
    assert all(r["source"] == f"s{i}" and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for i, r in out.items())


def test_classify_and_the_whole_run(spark, frame, tmp_path):
    texts, ids, docs = rows(frame)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality_classifier.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")) is None  # too few: all stay
    assert corpus_pipeline.classify(spark, docs, str(tmp_path)).count() == len(texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
    want = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.select("text").collect())
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
