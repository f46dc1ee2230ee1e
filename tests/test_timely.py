import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from grainfold.operators import experiments, temporal
from grainfold.streaming import state, usage


@pytest.mark.parametrize("ranges", [None, 1, 3, 9])
def test_asof_join_equals_brute_force_with_a_hot_key_over_ranges(spark, ranges):
    rnd = random.Random(ranges or 0)
    key = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", "z", None])
    left = [(i, key(), rnd.choice([None, *range(60)])) for i in range(300)]
    right = sorted({(key(), rnd.randint(0, 60), rnd.randint(0, 9)) for _ in range(60)} | {("z", None, 3)}, key=str)
    made = temporal.asof_join(
        spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, price int"), ["k"], "t", "at", ["price", "at"], ranges)
    assert made.columns == ["id", "k", "t", "price", "at"]
    want = []
    for i, k, t in left:
        met = [(a, p) for kk, a, p in right if k is not None and t is not None and kk == k and a is not None and a <= t]
        best = max(met, default=(None, None))
        want.append((i, k, t, best[1], best[0]))
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_a_price_reaches_over_several_ranges(spark):
    left = spark.createDataFrame([(i, 1, i) for i in range(1000)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 0, 7), (2, 0, 9)], "k int, at int, price int")
    made = temporal.asof_join(left, right, ["k"], "t", "at", ["price"], 8)
    assert made.where("price = 7").count() == 1000
    assert temporal.asof_join(left, right.limit(0), ["k"], "t", "at", ["price"], 4).where("price IS NULL").count() == 1000
    assert temporal.asof_join(left.limit(0), right, ["k"], "t", "at", ["price"]).count() == 0


def intervals(rnd, n):
    out = [(i, rnd.choice("ab"), s, s + rnd.choice([0, 1, 2, 3, 64, 1000, 10**6])) for i in range(n) for s in [rnd.randint(-2000, 2000)]]
    return out + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, None, 0, 10), (n + 3, "b", -(10**15), 10**15)]


def test_points_in_intervals_and_overlaps_equal_the_plain_comparison(spark):
    rnd = random.Random(9)
    one, two = intervals(rnd, 120), intervals(rnd, 90)
    points = [(i, rnd.choice("ab"), rnd.choice([None, *range(-2100, 2100)])) for i in range(300)]
    a = spark.createDataFrame(one, "i int, k string, s bigint, e bigint")
    b = spark.createDataFrame(two, "j int, k string, c bigint, d bigint")
    p = spark.createDataFrame(points, "p int, k string, at bigint")
    found = [(r["p"], r["i"]) for r in temporal.interval_join(p, a, "at", "s", "e", ("k",)).collect()]
    assert sorted(found) == sorted((q, i) for q, k, t in points for i, kk, s, e in one if None not in (k, t, s, e) and kk == k and s <= t < e)
    pairs = [(r["i"], r["j"]) for r in temporal.overlap_join(a, b, ("s", "e"), ("c", "d"), ("k",)).collect()]
    assert sorted(pairs) == sorted((i, j) for i, k, s, e in one for j, kk, c, d in two if None not in (k, s, e, c, d) and kk == k and s < e and c < d and s < d and c < e)
    alone = temporal.interval_join(p.drop("k"), a.drop("k"), "at", "s", "e").count()
    assert alone == sum(1 for _, _, t in points for _, _, s, e in one if None not in (t, s, e) and s <= t < e)
    assert temporal.interval_join(p, a.limit(0), "at", "s", "e", ("k",)).count() == 0


def test_overlaps_by_their_ends_alone_keep_intervals_without_length(spark):
    rnd = random.Random(3)
    one, two = intervals(rnd, 80) + [(200, "a", 7, 7), (201, "a", 9, 2)], intervals(rnd, 80) + [(200, "a", 0, 50), (201, "a", 7, 7), (202, "a", 5, 1)]
    a = spark.createDataFrame(one, "i int, k string, s bigint, e bigint")
    b = spark.createDataFrame(two, "j int, k string, c bigint, d bigint")
    pairs = [(r["i"], r["j"]) for r in temporal.overlap_join(a, b, ("s", "e"), ("c", "d"), ("k",), empty=True).collect()]
    want = sorted((i, j) for i, k, s, e in one for j, kk, c, d in two if None not in (k, s, e, c, d) and kk == k and s < d and c < e)
    assert sorted(pairs) == want and (200, 200) in want and (200, 201) not in want


def test_cube_and_rollup_tell_null_from_all(spark):
    rows = spark.createDataFrame([("x", None, 0.5), ("x", "a", 1.0), (None, "a", 0.0)], "config string, domain string, relevance double")
    rows = rows.withColumns({m: F.col("relevance") for m in ("utilization", "completeness")} | {"adherence": F.lit(True)})
    got = {(r["part_of"], r["config"], r["domain"]): (r["n"], r["relevance"]) for r in experiments.mean_cube(rows, "config", "domain").collect()}
    assert got[3, None, None] == (3, 0.5) and got[1, None, None] == (1, 0.0) and got[2, None, None] == (1, 0.5) and got[2, None, "a"] == (2, 0.5) and len(got) == 8
    assert {r["part_of"] for r in experiments.mean_rollup(rows, "config", "domain").collect()} == {0, 1, 3}


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_sessions_merge_by_late_events_until_the_watermark_has_passed(spark, tmp_path):
    source = tmp_path / "in"
    event = lambda t, user, v: {"ts": f"2024-01-01T{t}:00", "user_id": user, "value": v}
    put(source, "1.json", event("10:00", 1, 1.0), event("10:50", 1, 2.0), event("10:00", 2, 4.0))
    stream = spark.readStream.schema("ts timestamp, user_id bigint, value double").option("maxFilesPerTrigger", 1).json(str(source))
    q = usage.sessions(stream, "30 minutes", "2 hours").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "ck")).start()
    for name, rows in (("2.json", [event("10:25", 1, 8.0)]), ("3.json", [event("20:00", 3, 0.0)]), ("4.json", [event("10:10", 2, 16.0)]), ("5.json", [event("23:50", 3, 0.0)])):
        q.processAllAvailable()
        put(source, name, *rows)
    q.processAllAvailable()
    q.stop()
    got = {(r["user_id"], f"{r['start']:%H:%M}", f"{r['end']:%H:%M}", r["n"], r["value"]) for r in spark.sql("SELECT * FROM sessions").collect()}
    assert got == {(1, "10:00", "10:50", 3, 11.0), (2, "10:00", "10:00", 1, 4.0), (3, "20:00", "20:00", 1, 0.0)}


def test_totals_go_on_from_the_checkpoint_and_quiet_legs_are_told_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def call(no, leg, cost, minute):
        return {"leg": leg, "call_no": no, "cost_usd": cost, "ts": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).isoformat()}

    def run():
        stream = spark.readStream.schema("leg string, call_no bigint, cost_usd double, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        sink = state.leg_totals(stream, 0.25, "1 minute", 60).writeStream.outputMode("append").format("parquet").option("path", out)
        sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    put(source, "1.json", call(2, "gen", 0.1, 2), call(1, "gen", 0.1, 1), call(3, "judge", 0.2, 3))
    run()
    run()  # nothing new: nothing is counted twice
    put(source, "2.json", call(4, "gen", 0.1, 4), call(5, "gen", 0.000001, 5))
    run()
    put(source, "3.json", call(6, "judge", 0.1, 500))
    put(source, "4.json", call(7, "judge", 0.1, 501))
    run()
    rows = spark.read.schema(state.COSTS).parquet(out).collect()
    calls = {r["call_no"]: (r["leg"], r["leg_usd"], r["over_cap"]) for r in rows if r["kind"] == "call"}
    assert calls == {1: ("gen", 0.1, False), 2: ("gen", 0.2, False), 3: ("judge", 0.2, False), 4: ("gen", 0.3, True), 5: ("gen", 0.300001, True), 6: ("judge", 0.3, True), 7: ("judge", 0.4, True)}
    assert sum(r["kind"] == "call" for r in rows) == 7
    quiet = [(r["leg"], r["call_no"], r["leg_usd"]) for r in rows if r["kind"] == "quiet"]
    assert quiet.count(("gen", 4, 0.300001)) == 1 and {leg for leg, *_ in quiet} <= {"gen", "judge"} and len(quiet) <= 2
