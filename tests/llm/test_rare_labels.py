import random

from grainfold.llm import quality_classifier


def texts(rnd, n, extra=()):
    return [" ".join([*rnd.choices(["sun", "moon", "tree", "river", "stone", "cloud", "grass", "field"], k=30), *extra]) for _ in range(n)]


def test_content_view_learns_from_few_labels_and_a_rare_kind(spark, frame):
    rnd = random.Random(5)
    docs = frame([*texts(rnd, 80), *texts(rnd, 20, ["junk", "cheap"]), *texts(rnd, 8, ["vile"]), *texts(rnd, 4, ["vile"])])
    labels = spark.createDataFrame([(i, int(not 80 <= i < 100), int(i >= 100)) for i in range(108)], "doc_id bigint, quality int, toxic int")
    p = {r["doc_id"]: r["p_content"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    assert min(p[i] for i in range(80)) > max(p[i] for i in range(80, 112))


def test_bounded_sample_keeps_rare_kinds(spark, frame):
    rnd = random.Random(6)
    docs = frame(texts(rnd, 300))
    labels = spark.createDataFrame([(i, int(i % 100 != 1), int(i % 50 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    rows, stands = quality_classifier.sample(docs, labels, 60, 0)
    kind = [r["kind"] for r in rows.collect()]
    assert (kind.count(quality_classifier.TOXIC), kind.count(quality_classifier.LOW)) == (6, 3)
    assert len(kind) <= 60 and round(sum(stands[k] for k in kind)) == 300


def test_sample_of_repeated_rows_and_clashing_columns(spark, frame):
    rnd = random.Random(4)
    a, b = texts(rnd, 40), texts(rnd, 40, ["junk"])
    docs = frame([*a, *b, *b, None], [*range(80), *range(40), None]).withColumnsRenamed({"digest": "y", "block": "kind", "h": "row"})
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(3, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows, _ = quality_classifier.sample(docs, labels, 100, 100)
    found = sorted((r["doc_id"], bytes(r["words"])) for r in rows.collect())
    assert [i for i, _ in found] == [*range(80)]
    assert found == sorted((r["doc_id"], bytes(r["words"])) for r in quality_classifier.sample(docs.repartition(3), labels, 100, 100)[0].collect())
    assert quality_classifier.fit(docs.where("false"), labels) is None
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.score(docs, model).count() == 121 == quality_classifier.score(docs, None).where("kept").count()
    assert quality_classifier.keep_good(docs, model).schema == docs.schema
