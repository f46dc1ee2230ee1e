import json
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators import evaluation, judging, models


def test_labels_are_found_repaired_and_scored(spark):
    answers = [
        '{"all_relevant_sentence_keys": ["a", "a"], "overall_supported": "false"}',
        'x {"why": "a "b" c", "all_relevant_sentence_keys": ["a"], "overall_supported": false} y',
        "}{", None, '{"a": ', "[1]",
        '{"all_relevant_sentence_keys": null}', '{"all_utilized_sentence_keys": 3}',
        '```json\n{"overall_supported": []}\n``` and {"no": 1}', '{"overall_supported": [0], "all_relevant_sentence_keys": [1, "b"]}',
    ]
    rows = judging.scored(spark.createDataFrame(list(enumerate(answers)), "i int, answer string").withColumn("n_sentences", F.lit(4))).orderBy("i").collect()
    assert [r["failed"] for r in rows] == [False, False, True, True, True, True, True, True, False, False]
    assert [(r["relevance"], r["completeness"], r["adherence"]) for r in rows if not r["failed"]] == [(0.5, 0.0, True), (0.25, 0.0, False), (0.0, 1.0, False), (0.5, 0.0, True)]
    assert judging.escape_inner_quotes('{"k": "a \\" "b" c"}') == '{"k": "a \\" \\"b\\" c"}'


def test_column_and_function_find_the_same_object(spark):
    answers = ["{}", "a {b} c", "```\n{x}\n```", "} {", "{", "```json {1} ``` {2}", "no", "{a}{b}"]
    found = [r["x"] for r in spark.createDataFrame(list(enumerate(answers)), "i int, a string").orderBy("i").select(judging.json_part(F.col("a")).alias("x")).collect()]
    assert found == ["{}", "{b}", "{x}", None, None, "{1}", None, "{a}{b}"]
    assert judging.label_of('```json\n{"a": 1}\n```') == {"a": 1} and judging.label_of("{") is None


def test_grounding(spark):
    score = lambda t, r, u, n: spark.range(1).select(*evaluation.grounding(F.lit(t), *[F.array(*[F.lit(x) for x in k]).cast("array<string>") for k in (r, u, n)])).first()
    assert tuple(score(10, "aab", "a", "")) == (0.3, 0.1, 1 / 3, True)
    assert tuple(score(0, "", "a", "a")) == (0.0, 0.0, 1.0, False)
    assert score(4, "ab", "aab", "")["completeness"] == 1.0
    assert tuple(score(1, "abc", "b", "")) == (3.0, 1.0, 1 / 3, True)  # more keys than sentences are not cut off


ROWS = [(1, "Where is it?", ["It is here. It was there.", ""], "Here."), (2, None, [], None)]


def keyed(spark):
    df = spark.createDataFrame(ROWS, "i int, question string, texts array<string>, answer string")
    return df.withColumn("s", T.segmented(F.col("texts"), F.col("answer"))).select("i", "question", F.col("s.documents").alias("documents"), F.col("s.response").alias("response"))


def test_judge_prompt_and_fake_judge(spark):
    prompts = [r["p"] for r in keyed(spark).orderBy("i").select(judging.judge_prompt(F.col("question"), F.col("documents"), F.col("response"), True).alias("p")).collect()]
    assert "0a. It is here.\n0b. It was there.\n" in prompts[0] and "Where is it?" in prompts[0] and "a. Here." in prompts[0] and prompts[0].endswith(judging.CONSERVATIVE)
    assert all(name in prompts[0] for name in (judging.RELEVANT, judging.UTILIZED, judging.SUPPORTED)) and "{" not in prompts[0]
    rows = models.FakeJudge().scores(keyed(spark)).orderBy("i").collect()
    assert [(r["relevance"], r["utilization"], r["completeness"], r["adherence"], r["failed"]) for r in rows] == [(0.5, 0.5, 1.0, True, False), (0.0, 0.0, 1.0, True, False)]


@pytest.fixture
def server():
    """Answers by a function of (path, payload, calls so far); asked holds the payloads."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            payload = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            made.asked.append((self.path, payload, self.headers.get("Authorization")))
            status, headers, body = made.reply(payload, len(made.asked))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    made.asked, made.url = [], f"http://127.0.0.1:{made.server_port}"
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def test_local_generator(spark, server):
    server.reply = lambda p, n: (200, {}, {"response": p["prompt"].upper(), "eval_count": 3, "prompt_eval_count": 2, "done_reason": "stop"})
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, prompt string")
    rows = models.local_generator(host=server.url + "/", parallel=1).answers(df).orderBy("i").collect()
    assert [tuple(r)[2:] for r in rows] == [("AB", 2, 3, "stop"), ("", 2, 3, "stop")]
    path, payload, _ = server.asked[0]
    assert path == "/api/generate" and payload["options"] == {"temperature": 0.0, "num_ctx": 16384, "num_predict": 256} and payload["stream"] is False


def chat(content, **more):
    return {"choices": [{"message": {"content": content}, "finish_reason": "stop"}], **more}


def test_hosted_generator_waits_when_it_is_told_to(spark, server):
    server.reply = lambda p, n: (429, {"Retry-After": "0"}, {}) if n == 1 else (200, {}, chat(None, usage={"prompt_tokens": 7, "completion_tokens": 1}))
    df = spark.createDataFrame([(1, "ab")], "i int, prompt string")
    row = models.hosted_generator(url=server.url, api_key="k", parallel=1).answers(df).first()
    assert (row["answer"], row["in_tokens"], row["out_tokens"]) == ("", 7, 1)
    assert len(server.asked) == 2 and server.asked[0][2] == "Bearer k" and server.asked[0][1]["messages"] == [{"role": "user", "content": "ab"}]


def test_backoff(server):
    waits = []
    server.reply = lambda p, n: (429, {}, {}) if n < 4 else (200, {}, {"n": n})
    assert models.post(server.url, {}, {}, 5, retries=3, sleep=waits.append) == {"n": 4} and waits == [1.0, 2.0, 4.0]
    server.reply = lambda p, n: (429, {"Retry-After": "1200"}, {})
    with pytest.raises(models.RateLimited):
        models.post(server.url, {}, {}, 5, retries=3, sleep=waits.append)
    with pytest.raises(models.urllib.error.HTTPError):
        models.post(server.url, {}, {}, 5, retries=0, sleep=waits.append)
    server.reply = lambda p, n: (500, {}, {})
    with pytest.raises(models.urllib.error.HTTPError):
        models.post(server.url, {}, {}, 5, retries=3, sleep=waits.append)
    assert len(waits) == 3
    with pytest.raises(RuntimeError, match="NO_SUCH_KEY"):
        models.HostedChat(key_name="NO_SUCH_KEY").complete("x")


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = models.Pace(30, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [2.0, 2.0]
    models.Pace(0, sleep=sleep).wait()
    assert len(slept) == 2


def test_judge_asks_again_and_counts_failures(spark, server):
    good = '{"all_relevant_sentence_keys": ["0a"], "all_utilized_sentence_keys": ["0a"], "overall_supported": true}'

    def reply(p, n):
        if "Where is it?" not in p["prompt"]:
            return 500, {}, {}
        return 200, {}, {"response": good if p["options"]["temperature"] else "not json"}

    server.reply = reply
    judge = models.local_judge(host=server.url, parallel=1)
    rows = {r["i"]: r for r in judge.scores(keyed(spark)).collect()}
    assert (rows[1]["relevance"], rows[1]["utilization"], rows[1]["completeness"], rows[1]["adherence"], rows[1]["failed"]) == (0.5, 0.5, 1.0, True, False)
    assert rows[2]["failed"] and rows[2]["relevance"] is None and "500" in rows[2]["judge_error"]
    assert server.asked[0][1]["format"] == "json" and "num_predict" not in server.asked[0][1]["options"]


def test_hosted_judge_shares_its_calls_a_minute():
    judge = models.hosted_judge(requests_per_minute=60, parallel=4, api_key="k")
    assert judge.parallel == 4 and judge.load().pace.gap == 4.0 and judge.load().max_retries == 5 and judge.load().model == models.HOSTED_JUDGE
    assert models.hosted_judge(requests_per_minute=60).parallel == 1 and isinstance(models.own_judge("m").load, partial)


def test_reports_and_verdict(spark):
    rows = [(0.5, 0.0, 0.0, True, False), (0.1, 0.0, 0.0, False, False), (None, None, None, None, True)]
    df = spark.createDataFrame(rows, "relevance double, utilization double, completeness double, adherence boolean, failed boolean")
    df = df.withColumns({"relevance_ref": F.lit(0.3), "utilization_ref": F.lit(0.0), "completeness_ref": F.lit(0.0), "adherence_ref": F.lit(True), "config": F.lit("c")})
    r = judging.judge_report(df, "config").first()
    assert (r["n"], r["n_scored"], r["n_failed"], r["relevance_rmse"], r["relevance_mae"], r["relevance_signed"]) == (3, 2, 1, 0.2, 0.2, 0.0)
    assert (r["adherence_acc"], r["adherence_over_flag"], r["adherence_under_flag"]) == (0.5, 0.5, 0.0)
    one = judging.judge_report(df, "config").withColumn("model", F.lit("m"))
    old = one.withColumns({"relevance_rmse": F.lit(0.9), "prompt_variant": F.lit(None).cast("string")})
    got = judging.judge_verdict(old, one, one.withColumns({"config": F.lit("d"), "prompt_variant": F.lit("strict")})).orderBy("prompt_variant").collect()
    assert [(g["prompt_variant"], g["configs"], g["relevance_rmse"]) for g in got] == [("baseline", 1, 0.2), ("strict", 1, 0.2)]
    v = evaluation.validation(df, "config").first()
    assert (v["n"], v["relevance_max_gap"], v["utilization_exact"], v["adherence_correct"], v["adherence_accuracy"]) == (3, 0.2, 2, 1, round(1 / 3, 6))


def test_gap_tables(spark):
    df = spark.createDataFrame([("a", 0.25, 0.5, -0.25), ("b", None, None, None)], "config string, relevance double, relevance_ref double, relevance_gap double")
    for m in ("utilization", "completeness", "adherence"):
        df = df.withColumns({m: F.lit(1.0), f"{m}_ref": F.lit(0.0), f"{m}_gap": F.lit(1.0)})
    rows = {(r["config"], r["metric"]): tuple(r)[2:] for r in evaluation.gap_table(df, "config").collect()}
    assert rows["a", "relevance"] == (0.25, 0.5, "-0.250") and rows["b", "relevance"] == (None, None, "") and rows["a", "adherence"] == (1.0, 0.0, "+1.000")
    assert evaluation.plot_rows(df, "config").count() == 14
    got = {r["metric"]: tuple(r)[1:] for r in evaluation.gap_summary(df).collect()}
    assert got["relevance"] == (1, -0.25, 0.0, -0.25, -0.25) and "adherence" in got


def test_example_figures(spark):
    rows = [("s", ["a b c", ""]), ("s", ["x"]), ("t", []), ("u", ["w " * 900])]
    df = spark.createDataFrame(rows, "config string, documents array<string>")
    got = {r["config"]: r for r in evaluation.document_statistics(df, "config").collect()}
    assert (got["s"]["n"], got["s"]["docs_median"], got["s"]["docs_max"], got["s"]["words_median"], got["s"]["words_p95"], got["s"]["words_max"], got["s"]["chunking_lever"]) == (2, 1.5, 2, 1, 3, 3, "MEDIUM")
    assert got["t"]["chunking_lever"] == "?" and got["u"]["chunking_lever"] == "HIGH"
    assert [evaluation.nearest_rank(F.lit([1, 2, 3, 4]), p) is not None for p in (0.5,)] == [True]
    assert spark.range(1).select(evaluation.nearest_rank(F.array(*map(F.lit, (4, 1, 3, 2))), 0.5).alias("x"), evaluation.nearest_rank(F.array().cast("array<int>"), 0.5).alias("y")).first() == (3, None)
    present = {r["field"]: (r["expected"], r["present"], r["n_values"]) for r in evaluation.field_presence(df, ["config", "id"]).collect()}
    assert present == {"config": (True, True, 4), "id": (True, False, 0), "documents": (False, True, 4)}
    assert evaluation.only_in(df.select("config"), df.select("config").distinct()).count() == 1
