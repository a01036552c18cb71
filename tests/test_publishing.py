"""Reading and writing of plans, sidecars, shards and logs; cases of publishing that the SQL comparison doesn't show."""

import json

from pyspark.sql import functions as F

from turnlake.operators import allocation as A
from turnlake.operators import evaluation as E
from turnlake.operators import logs as L
from turnlake.operators import publishing as P
from turnlake.operators import quality as Q


def scenario(**changes):
    row = {"scenario_id": "a", "behaviour": "prefetch", "language": "en", "domain": "sales", "agent_state": "IDLE", "prosody": "flat", "gender": "male",
           "user_text": "hello there", "agent_text": "", "event_char": 3, "length_band": "short"}
    return {**row, **changes}


def test_verdicts(spark):
    """(schema_ok, vocab_ok) of records that are wrong in one way each."""
    cases = {
        "good": ({}, [("LISTEN", 0, "")], (True, True)), "prosody": ({"prosody": "sung"}, [("LISTEN", 0, "")], (False, True)), "empty": ({}, [], (False, True)),
        "brackets": ({}, [("LISTEN", 0, "[x]")], (True, False)), "markup": ({}, [("LISTEN", 0, "<x>")], (False, False)), "flag": ({}, [("NOPE", 0, "")], (False, False)),
        "lookalike": ({"behaviour": "barge_lookalike"}, [("BARGE_SOFT", 2, "")], (True, False)), "text": ({"user_text": "a [b] c", "event_char": 0}, [("LISTEN", 0, "")], (True, True)),
        "offset": ({}, [("LISTEN", -1, "")], (False, True)), "state": ({"agent_state": "NAPPING"}, [("LISTEN", 0, "")], (False, True)),
    }
    scenarios = spark.createDataFrame([scenario(scenario_id=k, **c[0]) for k, c in cases.items()])
    targets = spark.createDataFrame([(k, f, n, s) for k, c in cases.items() for f, n, s in c[1]], "scenario_id string, flag string, frame_offset int, spoken_text string")
    found = {r.scenario_id: (r.schema_ok, r.vocab_ok) for r in Q.verdicts(scenarios, targets).collect()}
    assert found == {k: c[2] for k, c in cases.items()}


def test_coerced_and_calls(spark):
    rows = spark.createDataFrame([scenario(agent_state=" ", gender=" male ", event_char=None, prosody=None)], "scenario_id string, behaviour string, language string, domain string, agent_state string, prosody string, gender string, user_text string, agent_text string, event_char string, length_band string")
    r = Q.coerced(rows).first()
    assert (r.agent_state, r.gender, r.event_char, r.prosody) == ("IDLE", "male", 0, "neutral")
    df = spark.createDataFrame([("HTTP 429",), ("rate limit hit",), ("other",), (None,)], "e string")
    assert [r[0] for r in df.select(Q.rate_limited(F.col("e"))).collect()] == [True, True, False, False]
    assert [round(r[0], 3) for r in spark.range(1).select(Q.projected_seconds(F.lit(0))).collect()] == [0.455]


def test_orchestrator(spark):
    steps = [("PREFETCH_LLM", "LLM_GEN", ""), ("TURN_END", "IDLE", ""), ("PREFETCH_LLM", "IDLE", ""), ("BARGE_HARD", "IDLE", ""), ("TURN_END", "IDLE", "ok"), ("COMMIT_LLM", "IDLE", ""), ("SILENCE_BREAK", "IDLE", ""), ("LISTEN", "IDLE", "hm")]
    df = spark.createDataFrame([("s", k, *x) for k, x in enumerate(steps)], "s string, k int, flag string, agent_state string, spoken string")
    found = [(r.prefetch_active, r.actions) for r in L.actions(df, "s", "k").orderBy("k").collect()]
    assert found == [(0, []), (0, ["prefetch", "turn_end"]), (0, ["prefetch"]), (1, ["barge_hard"]), (1, ["turn_end", "say"]), (1, ["commit"]), (0, ["say"]), (0, ["say"])]


def test_quotas_and_weights(spark):
    of = lambda rows, n: {r.name: r.quota for r in A.largest_remainder(spark.createDataFrame(rows, "name string, weight long"), n).collect()}
    assert of([("a", 15), ("b", 15)], 20) == {"a": 10, "b": 10} and of([("a", 3), ("b", 1), ("c", 0)], 9) == {"a": 3, "b": 1, "c": 0} and of([("a", 0)], 5) == {"a": 0}
    counts = spark.createDataFrame([(0, 100), (1, 1), (2, 0)], "flag int, n long")
    plain = {r.flag: r.weight for r in E.class_weights(counts).collect()}
    assert abs(plain[1] / plain[0] - 10) < 1e-9 and plain[1] == plain[2] and abs(sum(plain.values()) - 3) < 1e-9
    held = {r.flag: r.weight for r in E.class_weights(counts, most_ratio=4.0).collect()}
    assert abs(held[1] / held[0] - 4) < 1e-9


def test_plan_files(spark, tmp_path):
    plan = spark.createDataFrame([("prefetch", "en", "sales", "male", k, False, "short") for k in (3, 4)] + [("prefetch", "hi", "support", "female", 5, True, "long")], P.JOB_SCHEMA)
    P.write_plan(plan, str(tmp_path / "p"), 4)
    assert sorted(r["count"] for r in P.read_plan(spark, str(tmp_path / "p/plan")).collect()) == [3, 4, 5]
    assert P.read_plan(spark, str(tmp_path / "p/parts/*")).count() == 3
    summary = spark.read.json(str(tmp_path / "p/summary")).first()
    assert (summary.jobs, summary.scenarios) == (3, 12)


def test_sidecars_shards_and_lines(spark, tmp_path):
    words = [{"text": "hi", "start_s": 0.0, "end_s": 0.2, "start_char": 0, "end_char": 1}]
    (tmp_path / "a.words.json").write_text(json.dumps({"duration_s": 1.5, "words": words}, indent=1))
    (tmp_path / "b.words.json").write_text("{broken")
    found = {r.scenario_id: r for r in P.read_sidecars(spark, str(tmp_path)).collect()}
    assert found["a"].duration_s == 1.5 and found["a"].words[0].text == "hi" and found["b"].duration_s is None
    (tmp_path / "f1.jsonl").write_text('{"scenario_id": "x", "n": 1}\n{"scenario_id": "y", "n": 2}\n')
    (tmp_path / "f2.jsonl").write_text('{"scenario_id": "z", "n": 3}\n{"scen')
    rows = P.read_shards(spark, str(tmp_path / "f*.jsonl"), "scenario_id string, n int").collect()
    assert sorted((r.scenario_id, r.shard) for r in rows) == [("x", "f1.jsonl"), ("y", "f1.jsonl"), ("z", "f2.jsonl")]
    fallback = spark.createDataFrame([("x", "old"), ("w", "line")], "scenario_id string, line string")
    lines = {r.scenario_id: r.line for r in P.read_keyed_lines(spark, str(tmp_path / "f*.jsonl"), fallback).collect()}
    assert sorted(lines) == ["w", "x", "y", "z"] and lines["w"] == "line" and json.loads(lines["x"])["n"] == 1


def test_logs_and_deletion(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in ("r1", "r2", "r1"):
        P.append_log(spark.createDataFrame([("ok",)], "status string"), path, run)
    log = spark.read.parquet(path)
    assert log.count() == 3 and P.without_scope(log, run_id="r1").count() == 1 and P.without_scope(log).count() == 0
    df = spark.createDataFrame([("3:9",), ("0:3000",), ("5:5",), ("-1:4",), ("1:2:3",), ("a:b",), (None,)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(P.range_bounds(F.col("t"), F.lit(3000))).collect()] == [(3, 9), (0, 3000), None, None, None, None, None]
    paths = spark.createDataFrame([("/data/a/b.wav",), ("/database/x",)], "p string")
    assert [r[0] for r in paths.select(P.portable_path(F.col("p"), "/data")).collect()] == ["a/b.wav", "/database/x"]
    spent = spark.createDataFrame([(None, 0.0)], "cost_usd double, hours double")
    assert P.projection(spent, 10.0, 2.0, 40.0).first().projected == 20.0


def test_dropped_frames(spark):
    """The same frames at each run, about one in twenty of the valid ones."""
    frames = spark.range(20_000).select((F.col("id") % 10).alias("clip"), F.col("id").alias("frame"), (F.col("id") % 4 != 0).alias("valid"))
    kept = [sorted(r.frame for r in P.dropped_frames(f, "clip", "frame").where("kept").collect()) for f in (frames, frames.repartition(3))]
    assert kept[0] == kept[1] and all(k % 4 for k in kept[0]) and 0.03 < 1 - len(kept[0]) / 15_000 < 0.07
