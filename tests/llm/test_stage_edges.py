import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __own string, __row string, __keep string"
LONG = "word " * 3000 + "end"
ROWS = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (None, LONG), (5, "a b c d e f g"), (6, "a  b\tc d e f g"), (7, " "), (7, "another text of its own, which has some words")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "mine", "own", None) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_pass_other_columns_through_and_take_empty_tables(spark, docs, labelled, name, stage):
    out = stage(spark, docs, labelled)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all((r["__own"], r["__row"], r["__keep"]) == ("mine", "own", None) for r in rows)
    assert stage(spark, docs.limit(0), labelled).count() == 0


def test_what_each_stage_keeps(spark, docs, labelled):
    kept = lambda stage: sorted(((r["doc_id"], (r["text"] or "")[:6]) for r in stage(spark, docs, labelled).collect()), key=str)
    assert kept(corpus_pipeline.classify) == sorted(((i, (t or "")[:6]) for i, t in ROWS), key=str)
    assert kept(corpus_pipeline.drop_copies) == sorted([(1, ""), (3, "word w"), (5, "a b c "), (7, " "), (7, "anothe")], key=str)
    near = kept(corpus_pipeline.drop_near_copies)
    assert (3, "word w") in near and (5, "a b c ") in near and (6, "a  b\tc") not in near and (None, "word w") not in near and (4, "word w") not in near
    passages = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_passages(spark, docs, labelled).collect()}
    assert (3, LONG) in passages and (4, "") in passages and (1, "") in passages
    assert corpus_pipeline.pack(spark, docs, labelled).where("piece = 0").count() == len(ROWS)
