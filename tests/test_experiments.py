import json
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from grainfold import config
from grainfold.operators import experiments, models, registry
from grainfold.operators.registry import OPERATORS
from grainfold.plans import experiment, ledger
from grainfold.sources import tables
from grainfold.sources.committed import Committed
from grainfold.streaming import usage

STAGES = {"chunker": {"type": "fixed", "size": 4, "overlap": 0}, "embedder": {"type": "hashing"}, "index": {"type": "faiss"}, "retriever": {"type": "bm25", "k": 3}, "prompt": {"type": "minimal"}, "generator": {"type": "echo"}, "splitter": {"type": "regex"}}
PLAIN = {"domain": "Law", **STAGES}


def test_seeded_sample_is_reproducible_and_whole_when_large(spark):
    rows = spark.range(50).withColumnRenamed("id", "key")
    drawn = [[(r["sample_no"], r["key"]) for r in tables.seeded_sample(rows.repartition(p), 7, 3, "key").orderBy("sample_no").collect()] for p in (2, 5)]
    assert drawn[0] == drawn[1] == list(enumerate(random.Random(3).sample(range(50), 7)))
    assert tables.seeded_sample(rows, 60, 3, "key").count() == 50
    assert [r["key"] for r in tables.first_rows(rows, 3, "key").collect()] == [0, 1, 2]


def test_domain_is_the_union_of_its_sets(spark, tmp_path):
    for i, c in enumerate(("one", "two")):
        spark.range(3).selectExpr(f"'{c}' || id AS id", *(["id AS extra"] if i else [])).write.parquet(f"{tmp_path}/{c}/test")
    found = tables.read_domain(spark, str(tmp_path), "both", domains={"both": ["one", "two"]})
    assert found.count() == 6 and {r["_config"] for r in found.collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        tables.read_domain(spark, str(tmp_path), "both")
    with pytest.raises(ValueError):
        tables.read_examples(spark, str(tmp_path), "one", "dev")
    assert sum(map(len, tables.DOMAINS.values())) == 12 and tables.domain_of("cuad") == "Legal" and tables.domain_of("?") is None


def test_files_by_name(spark, tmp_path):
    for n in ("a_x.csv", "a_y.csv", "b_x.csv", "a_x.txt"):
        (tmp_path / n).write_text("")
    names = lambda *a: [p.rsplit("/", 1)[1] for p in tables.paths_like(spark, f"{tmp_path}/*.csv", *a)]
    assert names() == ["a_x.csv", "a_y.csv", "b_x.csv"] and names("a_") == ["a_x.csv", "a_y.csv"] and names("a_", ("y",)) == ["a_x.csv"]
    assert tables.paths_like(spark, f"{tmp_path}/none*") == []


def test_matrices_merge_with_the_last_row_of_a_name_at_the_place_of_the_first(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("config_id,domain,n,relevance\nx,Law,5,0.1\ny,Law,5,\n")
    b.write_text("config_name,config_id,domain,n,relevance\nw,w,Law,1,1\nx,z,Law,6,0.9\n")
    got = [((r["config_name"] or r["config_id"]), r["n"], r["relevance"]) for r in tables.read_matrices(spark, str(a), str(b)).orderBy("file_no", "line_no").collect()]
    assert got == [("x", 6, 0.9), ("y", 5, None), ("w", 1, 1.0)]


def test_rows_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(None, "i", "Law", 5), ("n", "i", "Law", 6)], "config_name string, config_id string, domain string, n int")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.MATRIX])
    path = f"{tmp_path}/matrix"
    for _ in range(2):
        tables.append_matrix(full, path)
    tables.append_matrix(full.withColumn("domain", F.lit("Health")), path)
    assert tables.read_matrix(spark, path).count() == 4 and tables.read_matrix(spark, f"{path}-none").count() == 0
    report = spark.createDataFrame([("M 1", "baseline", "Law", "c", 3)], "model string, prompt_variant string, domain string, config string, n int")
    whole = report.select("*", *[F.lit(0.5).alias(c) for c in tables.REPORT if c not in report.columns])
    at = tables.report_path(str(tmp_path), "M/1 (b)", "baseline", 30)
    assert at == f"{tmp_path}/judge_validation__m-1-b__baseline__n30"
    for _ in range(2):
        tables.append_reports(whole, at)
    found = tables.appended_rows(spark, at, tables.report_schema())
    assert found.count() == 1 and found.columns == tables.REPORT


def test_writers_at_once_write_each_cell_once(spark, tmp_path, monkeypatch):
    """Every writer stages its rows before any of them commits, so that all but one meet a conflict."""
    schema = t.StructType([t.StructField("cell", t.LongType()), t.StructField("who", t.StringType())])
    writers, path = 4, f"{tmp_path}/shared"
    barrier, claim, first = threading.Barrier(writers), Committed.claim, threading.local()

    def together(self, number, folder):
        if not getattr(first, "met", False):
            first.met = True
            barrier.wait(60)
        return claim(self, number, folder)

    monkeypatch.setattr(Committed, "claim", together)
    rows = [spark.createDataFrame([(c, f"writer {w}") for c in range(w, w + 5)], schema) for w in range(writers)]
    with ThreadPoolExecutor(writers) as pool:
        added = list(pool.map(lambda r: Committed(spark, path, schema).append(r, ["cell"]), rows))
    found = Committed(spark, path, schema).read().collect()
    assert sorted(r["cell"] for r in found) == list(range(writers + 4)) and sum(added) == writers + 4
    monkeypatch.undo()
    assert not Committed(spark, path, schema).claim(1, "late") and Committed(spark, path, schema).append(rows[0], ["cell"]) == 0
    (tmp_path / "shared" / "data" / "crashed").mkdir()
    assert Committed(spark, path, schema).read().count() == writers + 4


def charging(log):
    """Makes a client that writes down every call. Defined in here, so that workers get it by value."""

    class Client:
        def complete(self, prompt, sample=False):
            with open(log, "a") as f:
                f.write(prompt.rsplit("Question: ", 1)[-1].split("\n")[0] + "\n")
            return models.Completion("It is green. So it is.", 1000, 0)

    return lambda: Client()


def test_each_prompt_is_sent_once_whatever_the_splitter(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(OPERATORS.made, ("splitter", "halves"), lambda: lambda c: F.split(c, "[.] ?"))
    for kind in ("regex", "halves"):
        log = tmp_path / kind
        pipe = experiment.Pipeline(config.configured(PLAIN | {"splitter": {"type": kind}}))
        pipe.generator = models.Generator(charging(str(log)))
        rows = pipe.answers(examples(spark), judge=models.FakeJudge()).collect()
        assert len(rows) == 4 and len(log.read_text().splitlines()) == 4


def test_a_run_stops_at_the_call_that_passes_the_cap_and_goes_on_later(spark, tmp_path, monkeypatch):
    log, path = tmp_path / "calls", f"{tmp_path}/ledger"
    many = spark.createDataFrame([(i, f"Number {i:03} of all?", ["A door is green."]) for i in range(40)], "example_id bigint, question string, documents array<string>")
    monkeypatch.setitem(OPERATORS.made, ("generator", "charging"), lambda: models.Generator(charging(str(log)), 1, "m"))
    made = config.configured(PLAIN | {"generator": {"type": "charging"}})
    monkeypatch.setattr(ledger.Budget, "bound", lambda self, generator, judge: F.lit(0.002))
    budget = lambda cap, **more: ledger.Budget(spark, path, cap, [("m", 1.0, 1.0)], **more)
    with pytest.raises(ledger.CapPassed):
        experiment.run_experiment(made, many, models.FakeJudge(), name="one", budget=budget(0.0125))
    assert sorted(log.read_text().splitlines()) == [f"Number {i:03} of all?" for i in range(13)]  # 12 cost 0.012, the 13th passes it
    with pytest.raises(ledger.CapPassed):
        experiment.run_experiment(made, many, models.FakeJudge(), name="one", budget=budget(0.0125))
    assert len(log.read_text().splitlines()) == 13
    row = experiment.run_experiment(made, many, models.FakeJudge(), name="one", traces=f"{tmp_path}/traces", budget=budget(1.0, slice_rows=10)).first()
    assert row["n"] == row["n_scored"] == 40 and len(log.read_text().splitlines()) == len(set(log.read_text().splitlines())) == 40
    costs = {r["example_index"]: (r["cost"]["total_usd"], r["cost"]["gen_calls"], r["cost"]["gen_in_tokens"]) for r in spark.read.json(f"{tmp_path}/traces").collect()}
    assert costs == {i: (round(0.001 * (i + 1), 6), i + 1, 1000 * (i + 1)) for i in range(40)}
    other = experiment.run_experiment(made, many.limit(3), None, name="two", budget=budget(1.0)).first()
    assert other["n"] == 3 and budget(1.0).total() == 0.043
    spent = budget(1.0).spent.read().where("run like 'one%'").orderBy("slice").collect()
    assert [r["upto"] for r in spent][-3:] == [23, 33, 40] and sum(r["gen_calls"] for r in spent) == 40


def test_a_slice_that_crashed_is_asked_again_and_counted_once(spark, tmp_path):
    budget = ledger.Budget(spark, f"{tmp_path}/ledger", 1.0, [("m", 1.0, 1.0)], slice_rows=2)
    prompts, calls = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "example_id bigint, prompt string"), []
    none = {f"judge_{c}": F.lit(None).cast("bigint") for c in ("in_tokens", "out_tokens")}

    def answer(rows):
        calls.append(rows.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows.withColumns({"in_tokens": F.lit(10), "out_tokens": F.lit(0)} | none)

    generator = models.Generator(None, charged="m")
    with pytest.raises(RuntimeError):
        budget.run("r", prompts, answer, generator)
    assert budget.run("r", prompts, answer, generator).count() == 5 and calls == [2, 2, 2, 1] and budget.total() == 0.00005
    assert budget.run("empty", prompts.limit(0), answer, generator).count() == 0


def test_long_documents_equal_arrays(spark):
    pipe = experiment.Pipeline(config.configured(PLAIN | {"retriever": {"type": "bm25", "k": 2}}))
    rows = examples(spark)
    own = rows.select("example_id", F.posexplode("documents").alias("pos", "text"))
    short = lambda df: sorted(tuple(r) for r in df.select("example_id", "prompt", "context").collect())
    assert short(pipe.prompts(rows)) == short(pipe.prompts(rows.drop("documents"), documents=own))


def test_csv_has_a_header_and_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 0.5)], "x string, y double")
    tables.write_csv(df, f"{tmp_path}/out", ["y", "x"])
    part = next((tmp_path / "out").glob("part*")).read_text()
    assert part == "y,x\n,a\n0.5,b\n"


def test_traces_shorten_and_name_examples(spark, tmp_path):
    row = [("c/x", "D d", 4, None, "set", "q" * 510, "a", None, ["s", "t"], "four", None), ("c/x", "D d", 5, "own", "set", None, None, False, None, None, None)]
    df = spark.createDataFrame(row, "config_name string, domain string, example_index int, id string, _config string, question string, answer string, needs_retrieval boolean, sources array<string>, context string, scores string")
    got = tables.trace_records(df).orderBy("example_index").collect()
    assert (got[0]["example_id"], got[0]["question"], got[0]["n_sources"], got[0]["context_chars"], got[0]["needs_retrieval"]) == ("set_4", "q" * 500 + "...(+10 chars)", 2, 4, True)
    assert (got[1]["example_id"], got[1]["question"], got[1]["n_sources"], got[1]["context_chars"], got[1]["needs_retrieval"], got[1]["cost"]["total_usd"]) == ("own", "", 0, 0, False, 0.0)
    assert spark.range(1).select(tables.slug(F.lit("-A b/C_"))).first()[0] == "a-b-c"
    tables.write_traces(tables.trace_records(df), f"{tmp_path}/traces")
    lines = [json.loads(x) for p in (tmp_path / "traces" / "config=c-x" / "part_of=d-d").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["example_id"] for x in lines} == {"set_4", "own"} and lines[0]["cost"]["gen_calls"] == 0


def test_grid_names_and_registry():
    assert experiments.config_id(STAGES) == "fixed|hashing|faiss|bm25|none|none|none|minimal|echo"
    assert len(experiments.grid({"a": STAGES}, ["x", "y"])) == 2
    with pytest.raises(ValueError):
        experiments.grid({"a": STAGES, "b": STAGES}, ["x"])
    r = registry.Registry()
    r.register("chunker", "c", "d")(dict)
    r.register("chunker", "c")(dict)
    assert r.build("chunker", "c", size=1) == {"size": 1} and r.available("chunker") == ["c", "d"]
    with pytest.raises(ValueError):
        r.register("chunker", "c")(list)
    with pytest.raises(KeyError):
        r.build("chunker", "e")


def test_configurations(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("domain: Law\n" + "".join(f"{k}: {json.dumps(v)}\n" for k, v in STAGES.items()) + "reranker:\nseed: 7\n")
    made = config.configuration_at(str(path))
    assert made.seed == 7 and made.reranker is None and made.chunker == config.Stage("fixed", {"size": 4, "overlap": 0})
    wrong = [{k: v for k, v in PLAIN.items() if k != "splitter"}, {k: v for k, v in PLAIN.items() if k != "domain"}, PLAIN | {"chunker": "fixed"}, PLAIN | {"prompt": {"kind": "x"}}, PLAIN | {"retriever": {"type": "nothing"}}, PLAIN | {"domain": ""}]
    for raw in wrong:
        with pytest.raises(ValueError):
            config.configured(raw)
    path.write_text("- 1\n")
    with pytest.raises(ValueError):
        config.configuration_at(str(path))


def test_costs_of_unknown_models_and_the_cap_on_both_legs(spark):
    calls = spark.createDataFrame([("gen", 1, "m", 10**6, 0), ("judge", 2, "n", 0, 10**6), ("gen", 3, "?", 10**6, 10**6), ("judge", 4, "m", None, None)], "leg string, call_no int, model string, in_tokens bigint, out_tokens bigint")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("n", 0.5, 3.0)], experiments.PRICE_COLUMNS)
    for parts in (1, 3):
        got = [(r["cost_usd"], r["leg_usd"], r["total_usd"], r["over_cap"]) for r in experiments.costs(calls.repartition(parts), prices, 4.0).orderBy("call_no").collect()]
        assert got == [(1.0, 1.0, 1.0, False), (3.0, 3.0, 4.0, False), (4.0, 5.0, 8.0, True), (0.0, 3.0, 8.0, True)]
    state = experiments.cost_state(calls, prices)
    s = state.first()
    assert (s["gen"]["calls"], s["gen"]["in_tokens"], s["judge"]["cost_usd"], s["total_usd"], s["hard_cap_usd"]) == (2, 2 * 10**6, 3.0, 8.0, 4.5)
    assert experiments.cost_line(state).first()["line"] == "gen 2 calls $5.0000 | judge 2 calls $3.0000 | total $8.0000 of $4.50"
    assert experiments.cost_state(calls.where("false"), prices).first()["total_usd"] == 0.0


def test_usage_survives_broken_lines(spark, tmp_path):
    calls = spark.createDataFrame([("gen", 1, "m", 5, None)], "leg string, call_no bigint, model string, in_tokens bigint, out_tokens bigint")
    tables.append_usage(calls, f"{tmp_path}/usage")
    (tmp_path / "usage" / "broken.json").write_text('{"leg": "ge')
    assert [tuple(r) for r in tables.read_usage(spark, f"{tmp_path}/usage").collect()] == [("gen", 1, "m", 5, 0)]
    tables.write_state(experiments.cost_state(calls, spark.createDataFrame(experiments.PRICES, experiments.PRICE_COLUMNS)), f"{tmp_path}/state")
    assert json.loads(next((tmp_path / "state").glob("*.json")).read_text())["gen"]["calls"] == 1


def test_stream_of_costs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"leg": "gen", "model": "m", "in_tokens": 1000000, "out_tokens": 0}\n' * 2 + '{"leg": "judge", "model": "?", "in_tokens": 1000000, "out_tokens": 1000000}\n')
    prices = spark.createDataFrame([("m", 1.5, 2.0)], experiments.PRICE_COLUMNS)
    q = usage.running_cost(usage.call_stream(spark, str(tmp_path / "in")), prices).writeStream.outputMode("complete").format("memory").queryName("costs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.sql("SELECT leg, calls, cost_usd FROM costs").collect()) == [("gen", 2, 3.0), ("judge", 1, 3.5)]


def test_late_events_are_left_out_of_closed_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    def put(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"ts": f"2024-01-01T{t}:00", "event_type": "a", "value": v}) + "\n" for t, v in rows))

    put("1.json", ("00:10", 1.0), ("00:50", 2.0))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = usage.window_counts(events).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    for name, row in (("2.json", ("03:00", 4.0)), ("3.json", ("00:20", 8.0)), ("4.json", ("06:00", 16.0))):
        q.processAllAvailable()
        put(name, row)
    q.processAllAvailable()
    q.stop()
    assert sorted((r["start"].hour, r["n"], r["value"]) for r in spark.sql("SELECT * FROM windows").collect()) == [(0, 2, 3.0), (3, 1, 4.0)]


def test_figures_of_examples(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.0, 1.0, True), ("a", None, None, None, None), ("b", None, None, None, None)], "domain string, relevance double, utilization double, completeness double, adherence boolean")
    got = {r["domain"]: r for r in experiments.means(rows, "domain").collect()}
    assert (got["a"]["n"], got["a"]["n_scored"], got["a"]["relevance"], got["a"]["adherence"], got["a"]["scoring"]) == (2, 1, 0.5, 1.0, "done")
    assert (got["b"]["relevance"], got["b"]["scoring"]) == (None, "pending (no judge)")
    ref = spark.createDataFrame([("a", 0.25, 0.0, 0.0, 0.5)], "domain string, relevance double, utilization double, completeness double, adherence double")
    both = experiments.comparison(experiments.means(rows, "domain"), ref, "domain")
    assert both.columns[-8:] == ["relevance_ref", "relevance_gap", "utilization_ref", "utilization_gap", "completeness_ref", "completeness_gap", "adherence_ref", "adherence_gap"]
    assert {r["domain"]: r["relevance_gap"] for r in both.collect()} == {"a": 0.25, "b": None}
    done = spark.createDataFrame([("stop", 100), ("length", 5), ("stop", 241), (None, None)], "done_reason string, n_tokens int")
    assert tuple(experiments.length_cap(done, 256).first()) == (0.5, 100, True)


EXAMPLES = [
    (1, "Which colour is the door?", ["The door is painted green today. Walls stay white all year long.", "Nothing else matters here at all."]),
    (2, "thanks", ["The roof leaks in winter only now."]),
    (3, "Where does the river end?", ["Every river ends in the sea here. Lakes do not move at all.", ""]),
    (4, "Anything about the empty set?", []),
]


def examples(spark):
    return spark.createDataFrame(EXAMPLES, "example_id bigint, question string, documents array<string>")


@pytest.mark.parametrize("mode", ["per_example", "pooled"])
@pytest.mark.parametrize("retriever", ["dense", "bm25", "hybrid", "mmr"])
def test_an_experiment_from_end_to_end(spark, mode, retriever):
    raw = PLAIN | {"chunker": {"type": "fixed", "size": 12, "overlap": 0}, "index": {"type": "faiss", "corpus_mode": mode}, "retriever": {"type": retriever, "k": 3}, "reranker": {"type": "lexical", "top_n": 2}, "repacker": {"type": "reverse"}, "summarizer": {"type": "lexical"}, "query_classifier": {"type": "heuristic"}}
    rows = {r["example_id"]: r for r in experiment.Pipeline(config.configured(raw)).answers(examples(spark), judge=models.FakeJudge()).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert not rows[2]["needs_retrieval"] and rows[2]["sources"] == [] and rows[2]["context"] == "" and rows[2]["relevance"] == 0.0
    assert "The door is painted green today." in rows[1]["context"] and rows[1]["answer"].startswith("[ECHO] received a prompt of")
    assert len(rows[1]["sources"]) == 2 and [s["place"] for s in rows[1]["sources"]] == [0, 1] and [s["rank"] for s in rows[1]["sources"]] == [1, 0]
    assert rows[1]["context"] == "\n".join(s["text"] for s in rows[1]["sources"]) and "river" not in rows[1]["context"]
    assert len(rows[4]["sources"]) == (0 if mode == "per_example" else 2)
    assert rows[1]["prompt"].endswith("Question: Which colour is the door?\nAnswer:") and rows[1]["adherence"]


def test_matrix_goes_on_where_it_stopped(spark, tmp_path):
    asked = []

    def examples_for(domain):
        asked.append(domain)
        return examples(spark)

    cells = [("one", config.configured(PLAIN)), ("two", config.configured(PLAIN | {"repacker": {"type": "sides"}}))]
    path = f"{tmp_path}/matrix"
    experiment.run_matrix(spark, cells[:1], examples_for, path, judge=models.FakeJudge(), traces=f"{tmp_path}/traces")
    got = {r["config_name"]: r for r in experiment.run_matrix(spark, cells, examples_for, path).collect()}
    assert asked == ["Law", "Law"] and set(got) == {"one", "two"}
    assert (got["one"]["n"], got["one"]["n_scored"], got["one"]["scoring"], got["one"]["config_id"]) == (4, 4, "done", "fixed|hashing|faiss|bm25|none|none|none|minimal|echo")
    assert (got["two"]["n_scored"], got["two"]["relevance"], got["two"]["scoring"]) == (0, None, "pending (no judge)")
    traces = spark.read.json(f"{tmp_path}/traces")
    assert {r["example_id"] for r in traces.collect()} == {"1", "2", "3", "4"} and traces.where("scores.relevance IS NOT NULL").count() == 4


def test_pooled_corpus_holds_each_text_once(spark):
    pipe = experiment.Pipeline(config.configured(PLAIN | {"index": {"type": "faiss", "corpus_mode": "pooled"}, "chunker": {"type": "none"}}))
    corpus = spark.createDataFrame([(5, "b"), (3, "a"), (9, "b"), (1, "c"), (7, " ")], "doc_id bigint, text string")
    assert [(r["chunk_id"], r["text"]) for r in pipe.chunks(examples(spark), corpus).orderBy("doc_id").collect()] == [("0-0", "c"), ("1-0", "a"), ("2-0", "b")]


def test_chunks_of_an_example_are_in_few_files(spark):
    """Before, each file had chunks of every example, and each task counted words and filled blocks for all of them."""
    pipe = experiment.Pipeline(config.configured(PLAIN))
    own = spark.createDataFrame([(i % 40, i, f"oak w{i} elm fir yew ash") for i in range(4000)], "example_id bigint, pos bigint, text string").repartition(4)
    chunks = pipe.chunks(own, documents=own)
    files = chunks.select("corpus_id", F.input_file_name().alias("f")).distinct().groupBy("corpus_id").count()
    assert chunks.count() == 8000 and files.agg(F.sum("count")).first()[0] < 60


def test_validation_sweep_goes_on_where_it_stopped(spark, tmp_path):
    sentences = [[("0a", "One."), ("0b", "Two.")], [("1a", "Three."), ("1b", "Four.")]]
    rows = [(i, "Q?", sentences, [("a", "Yes.")], 0.5, 0.25, 0.5, i < 2) for i in range(3)]
    keyed = "array<struct<key: string, text: string>>"
    gold = spark.createDataFrame(rows, f"example_id int, question string, documents_sentences array<{keyed}>, response_sentences {keyed}, relevance_score double, utilization_score double, completeness_score double, adherence_score boolean")
    asked = []

    def examples_for(name):
        asked.append(name)
        return gold

    sweep = lambda *cells: experiment.run_validation(spark, models.FakeJudge(), "Some/Model", "baseline", [("Law", c) for c in cells], examples_for, str(tmp_path), 3)
    sweep("one")
    got = {r["config"]: r for r in sweep("one", "two").collect()}
    assert asked == ["one", "two"] and set(got) == {"one", "two"}
    r = got["two"]
    assert (r["n"], r["n_scored"], r["n_failed"], r["relevance_rmse"], r["utilization_signed"], r["completeness_mae"]) == (3, 3, 0, 0.0, 0.0, 0.0)
    assert (r["adherence_acc"], r["adherence_over_flag"], r["adherence_under_flag"]) == (round(2 / 3, 6), 0.0, round(1 / 3, 6))
    assert experiment.validated(models.FakeJudge(), gold, 2).count() == 2
