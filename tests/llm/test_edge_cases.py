"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, through the DataFrames."""

import hashlib
import os

import public_tokenizers
import pytest

from grainfold.llm import bpe, exact_dedup, jaccard_join, line_dedup, lm_scores, packing, quality_classifier, quality_rules, span_dedup, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "some words that go on and on, " * 20_000
EDGE = [None, "", " \n\t", LONG, LONG, "a", "a", "tie one two three four five six", "tie one two three four five six", "\0é日本🙂"]
IDS = [1, 2, 3, 4, 5, 6, 6, 7, 8, None]
OPERATORS = {
    "packing": lambda d: packing.best_fit_packing(d, JSON),
    "span": span_dedup.span_dedup,
    "rules": quality_rules.quality_rules,
    "scores": lm_scores.lm_scores,
    "jaccard": jaccard_join.jaccard_components,
    "exact": lambda d: exact_dedup.once(d, 2),
    "lines": line_dedup.line_dedup,
    "bpe": lambda d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "counts": lambda d: token_counts.within_budget(token_counts.prefix_tables(d, JSON, public_tokenizers.PATTERN), 512),
    "classifier": lambda d: quality_classifier.score(d, None),
}


@pytest.fixture(scope="module")
def odd(frame):
    """Extra columns named like columns inside the operators."""
    names = {"lang": "block", "source": "slice", "n_chars": "digest", "digest": "line", "block": "place", "h": "kind"}
    return frame(EDGE, IDS).withColumnsRenamed(names)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row_and_none_for_none(odd, name):
    rows = OPERATORS[name](odd).collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if name == "packing":
        ids = sorted((r["doc_id"] for r in rows if r["piece"] == 0), key=str)
    assert ids == sorted(IDS, key=str)
    assert OPERATORS[name](odd.where("false")).count() == 0


def test_rules_counts_and_codes_of_edges(odd):
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert [(rules[i]["n_words"], rules[i]["base_failed"], rules[i]["kept"]) for i in (1, 2, 3)] == [(0, True, False)] * 3
    assert rules[4]["n_words"] == 140_000 and rules[4]["n_repeat_words"] == 140_000 and rules[4]["base_failed"]
    counts = {r["doc_id"]: r for r in token_counts.within_budget(token_counts.prefix_tables(odd, JSON, public_tokenizers.PATTERN), 512).collect()}
    assert [(counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) for i in (1, 2)] == [(0, 0, False)] * 2
    assert counts[4]["over_limit"] and counts[None]["n_bytes"] == 13
    codes = {r["doc_id"]: r for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert codes[1]["n_tokens"] == 0 and codes[1]["ids_sha256"] == codes[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert codes[4]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_lines_of_edges(frame):
    long = "x" * 30
    rows = {r["doc_id"]: (r["text"], r["n_exact"]) for r in line_dedup.line_dedup(frame([long, None, "", f"{long}\n{long}"], [3, 2, 1, 4])).collect()}
    assert rows == {3: (long, 0), 2: (None, 0), 1: ("", 0), 4: ("", 2)}


def test_a_line_that_fills_most_rows_is_cut_in_parts(spark, frame):
    hot, cold = "the one line that everybody has", "a line of its own, number {}"
    texts = [f"{hot}\n{cold.format(i)} {'pqrstuvw'[i % 8] * (3 + i // 8)}" for i in range(60)]
    docs = frame(texts)
    distinct = line_dedup.distinct_lines(line_dedup.lines(docs, "doc_id", "text", 20))
    parts = [r["parts"] for r in line_dedup.hot_lines(distinct).collect()]
    assert max(parts) == 8  # half of all lines, of four tasks' sixteen quarters
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[0]["text"] == texts[0] and all(hot not in rows[i]["text"] and rows[i]["n_exact"] == 1 for i in range(1, 60))


def test_jaccard_filters_meet_before_sets_travel(frame):
    words = [f"w{i}" for i in range(400)]
    base = [words[i * 8 : i * 8 + 60] for i in range(40)]  # neighbours overlap, but too little for a link
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1]) for b in base[:10]]
    report = []
    rows = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(texts), report=report).collect()}
    assert all(rows[40 + i] == rows[i] for i in range(10))
    assert all(after <= before for before, after in report) and sum(a for _, a in report) >= 10


def test_sets_of_one_number_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 7, 100), (2, 5, 7, 200), (3, 5, 7, 100), (4, 5, 8, 300), (5, 0, 7, 999)], "doc_id bigint, n_shingles bigint, set_id bigint, second bigint")
    got = {r["doc_id"]: r["set_id"] for r in jaccard_join.told_apart(rows).collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 8) and got[4] == 8
    assert jaccard_join.told_apart(rows.where("doc_id != 2")).collect() == rows.where("doc_id != 2").collect()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the test tables")
def test_classifier_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 5 = 3")
    model = quality_classifier.fit(docs, labels.where("doc_id % 5 != 3"))
    seen = quality_classifier.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    bad, good = [r for r in seen if r["quality"] == 0 or r["toxic"] == 1], [r for r in seen if r["quality"] == 1 and r["toxic"] == 0]
    rejected, kept = sum(not r["kept"] for r in bad) / len(bad), sum(r["kept"] for r in good) / len(good)
    print(f"rejected {rejected:.3f} of {len(bad)}, kept {kept:.3f} of {len(good)}")
    assert rejected >= 0.9 and kept >= 0.97
