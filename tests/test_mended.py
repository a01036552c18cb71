"""Voices by whole hashes, last lines, blanks, budgets, quantiles, moves, inventories and the nested report, by brute force."""

import collections
import glob
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.functions.exprs import blank, md5_mod, script_ok
from turnlake.operators import audits, evaluation, frames, publishing, quality, storage, vad
from turnlake.sources import codec, moves


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_whole_hash_modulo_a_column(spark):
    rows = [(f"text {i}", n) for i in range(40) for n in (1, 2, 3, 5, 6, 7, 999_999_999)]
    df = spark.createDataFrame([*rows, ("x", 0), ("y", None), ("", 7)], "t string, n int").withColumn("m", md5_mod(F.col("t"), F.col("n")))
    for r in df.collect():
        assert r.m == (int(hashlib.md5(r.t.encode()).hexdigest(), 16) % r.n if r.n else None)
    voices = spark.createDataFrame([("male", v, i) for i, v in enumerate("abc")] + [("female", v, i) for i, v in enumerate("uvwxyz!")], "gender string, voice string, place int")
    texts = spark.createDataFrame([(f"t{i}", g) for i in range(30) for g in ("male", "female", "none")], "t string, gender string")
    names = {"male": "abc", "female": "uvwxyz!"}
    for r in publishing.voice_of(texts, voices, F.col("t")).collect():
        assert r.voice == (names[r.gender][int(hashlib.md5(r.t.encode()).hexdigest(), 16) % len(names[r.gender])] if r.gender in names else None)


def test_default_voices_fill_place_by_place(spark):
    rng = random.Random(0)
    for wanted, have in ((9, 4), (3, 8), (0, 5), (5, 0)):
        places = [(rng.choice("fm"), f"n{i:02d}", str(i)) for i in range(wanted)]
        catalogue = [(rng.choice("fm"), f"v{i}", i) for i in range(have)]
        used = [c[:2] for c in catalogue if rng.random() < 0.3]
        found = publishing.default_fill(spark.createDataFrame(places, "gender string, name string, hash string"), spark.createDataFrame(catalogue, "gender string, voice string, place int"), spark.createDataFrame(used, "gender string, voice string"))
        want = []
        for g in "fm":
            free = [v for x, v, _ in sorted(catalogue, key=lambda c: c[2]) if x == g and (g, v) not in used]
            want += [(g, n, free[k] if k < len(free) else None) for k, n in enumerate(sorted(n for x, n, _ in places if x == g))]
        assert rows_of(found, "gender", "name", "voice") == sorted(want, key=repr)


def test_the_last_line_of_a_key(spark, tmp_path):
    lines = [{"scenario_id": k, "n": n} for k, n in (("a", 9), ("b", 1), ("a", 2), ("c", 7), ("b", 0))]
    (tmp_path / "f1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    (tmp_path / "f2.jsonl").write_text(json.dumps({"scenario_id": "c", "n": 3}) + "\n")
    fallback = spark.createDataFrame([("z", "line"), ("a", "old")], "scenario_id string, line string")
    found = {r.scenario_id: r.line for r in publishing.read_keyed_lines(spark, str(tmp_path / "f*.jsonl"), fallback).collect()}
    assert {k: json.loads(v)["n"] for k, v in found.items() if k != "z"} == {"a": 2, "b": 0, "c": 3} and found["z"] == "line"


def test_blanks(spark):
    texts = ["", " ", "\t\n", " 　", "\x1f", None, "x", " हाँ "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(blank(F.col("t"))).collect()] == [not (t or "").strip() for t in texts]
    assert [r[0] for r in df.select(script_ok(F.col("t"), F.lit("hi"))).collect()][:6] == [False] * 6
    row = spark.createDataFrame([("\t\n", "short", 0)], "user_text string, length_band string, event_char int").withColumns(
        {c: F.lit("") for c in ("behaviour", "language", "domain", "agent_state", "prosody", "gender")})
    assert "empty user text" in row.select(quality.problems().alias("p")).first().p


def test_no_budget_no_part(spark):
    spent = spark.createDataFrame([(5.0, 1.0)], "cost_usd double, hours double")
    assert publishing.projection(spent, 10.0, 2.0, 0.0).first().budget_pct == 0.0
    assert publishing.projection(spent, 10.0, 2.0, 100.0).first().budget_pct == 50.0


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_percentiles_by_refinement(spark, bins):
    rng = np.random.default_rng(bins)
    marks = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    sets = [[], [3.0], [1.0] * 50, rng.normal(size=501), [*[0.1] * 400, *rng.normal(size=300)], [-1.7e308, 1.7e308, 0.0, 5e-324], [1e300, 1.0, 2.0, 3.0, 2.5]]
    for values in sets:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        found = evaluation.percentiles(df, "x", marks, bins)
        assert found == [None] * len(marks) if not len(values) else np.allclose(found, [interpolated(sorted(values), p) for p in marks], rtol=1e-12)


def test_percentiles_between_equal_values(spark):
    """A mark between equal values is that value to the last bit: scores are held against it."""
    values = [52.07] * 700 + [92.02] * 301
    marks = [0.01 + 0.98 * k / 40 for k in range(41)]
    found = evaluation.percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", marks)
    assert set(found) == {52.07, 92.02}
    assert found == spark.createDataFrame([(v,) for v in values], "x double").agg(F.percentile("x", F.array(*map(F.lit, marks)))).first()[0]


def interpolated(values, p):
    x = p * (len(values) - 1)
    low, high = int(np.floor(x)), int(np.ceil(x))
    return values[low] if low == high else (high - x) * values[low] + (x - low) * values[high]


def test_moves_and_reruns(spark, tmp_path):
    for folder, name in (("a", "1"), ("a/b", "2"), ("c", "1"), ("c", "3")):
        os.makedirs(tmp_path / "in" / folder, exist_ok=True)
        (tmp_path / "in" / folder / f"{name}.json").write_text(folder)
    os.makedirs(tmp_path / "out")
    (tmp_path / "out" / "3.words.json").write_text("there")
    run = lambda: moves.moved_flat(spark, f"file://{tmp_path}/in", "*.json", f"file://{tmp_path}/out", F.regexp_replace("name", r"\.json$", ".words.json")).collect()
    assert sorted((r.name, r.state) for r in run()) == [("1.words.json", "moved"), ("1.words.json", "skipped"), ("2.words.json", "moved"), ("3.words.json", "skipped")]
    assert {r.state for r in run()} == {"skipped"}
    assert {os.path.basename(p): open(p).read() for p in glob.glob(f"{tmp_path}/out/*")} == {"1.words.json": "a", "2.words.json": "a/b", "3.words.json": "there"}


def test_moves_list_by_tasks(spark, tmp_path):
    """Files in many folders are listed by some tasks and not by one a folder, which took 4 ms a folder and more."""
    rows = spark.range(600).select(F.concat(F.col("id") % 300, F.lit("/user_id="), F.col("id") % 450, F.lit(".json")).alias("name"), F.col("id").cast("string").alias("line"))
    written = {r.name: r.lines for r in moves.write_lines(rows, f"file://{tmp_path}/in").collect()}
    assert written == collections.Counter(r.name for r in rows.collect())
    assert {k: sorted(open(f"{tmp_path}/in/{k}").read().split()) for k in written} == {k: sorted(r.line for r in rows.collect() if r.name == k) for k in written}
    spark.sparkContext.setJobGroup("moves", "")
    found = moves.moved_flat(spark, f"file://{tmp_path}/in", "*.json", f"file://{tmp_path}/out").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("moves") for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 100
    assert len(found) == len(written) and sum(r.state == "moved" for r in found) == len({r.name for r in found}) == len(os.listdir(tmp_path / "out"))


def test_tracks_in_a_row(spark):
    """Tracks from a clip's energy as one array are those of windows over its frames, which took six shuffles of all frames."""
    rng = random.Random(7)
    clips = [[rng.choice([0.0, 0.1, 3.0, 4.0, 5.5, rng.uniform(0, 9)]) * (0.05 if c % 9 == 0 else 1) for _ in range(rng.randrange(1, 60))] for c in range(120)]
    rows = spark.createDataFrame([(c, f, e) for c, x in enumerate(clips) for f, e in enumerate(x)], "clip int, frame int, e double")
    wanted = {(r.clip, r.frame): r.speaking for r in vad.smoothed(vad.hysteresis(rows)).collect()}
    whole = spark.createDataFrame(list(enumerate(clips)), "clip int, e array<double>").select("clip", vad.heard_track(F.col("e")).alias("track"))
    assert {(r.clip, f): v for r in whole.collect() for f, v in enumerate(r.track)} == wanted
    sized = spark.createDataFrame([(c, len(x), len(x)) for c, x in enumerate(clips)], "clip int, num_frames int, audio_frames int")
    plan = frames.with_track(sized, rows, "clip")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    assert {(r.clip, f): v for r in plan.collect() for f, v in enumerate(r.vad)} == wanted


def test_inventory_with_sidecars(spark, tmp_path):
    car = lambda name, text: (tmp_path / f"{name}.words.json").write_text(text)
    for name, size in (("good", 500), ("small", 44), ("alone", 300), ("broken", 300), ("silent", 300), ("wordless", 300)):
        (tmp_path / f"{name}.wav").write_bytes(b"x" * size)
    words = [{"text": "a", "start_s": 0.0, "end_s": 1.0, "start_char": 0, "end_char": 1}]
    for name, seconds, w in (("good", 1.0, words), ("small", 1.0, words), ("silent", 0.0, words), ("wordless", 1.0, []), ("orphan", 2.0, words)):
        car(name, json.dumps({"duration_s": seconds, "words": w}))
    car("broken", "{nope")
    found = {r.scenario_id: r.reasons for r in moves.inventory_report(spark, f"file://{tmp_path}").collect()}
    assert found == {"good": [], "small": ["too small (44 bytes)"], "alone": ["no sidecar"], "broken": ["sidecar unreadable"], "silent": ["no duration"],
                     "wordless": ["no words in spite of a duration"], "orphan": ["sidecar without sound"]}


def test_report_reads_frames_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, f, rng.randrange(11), f"b{c % 3}", "hi" if c % 2 else "en", rng.random() < 0.1) for c in range(40) for f in range(rng.randrange(1, 30))]
    spark.createDataFrame(rows, "clip int, frame int, flag int, behaviour string, language string, spoken boolean").write.parquet(str(tmp_path / "f"))
    made = audits.corpus_report(spark.read.parquet(str(tmp_path / "f")), least_clips=25)
    report = json.loads(made.first().report)
    clips = {r[0]: r for r in rows}
    assert report["clips"] == 40 and report["frames"] == len(rows) and report["min_clips_per_flag"] == 25
    assert report["clips_with_spoken_text"] == len({r[0] for r in rows if r[5]})
    for k, name in enumerate(audits.FLAGS):
        holders = {r[0] for r in rows if r[2] == k}
        assert report["frame_counts"].get(name, 0) == sum(r[2] == k for r in rows) and report["clip_counts"].get(name, 0) == len(holders)
        assert report["deficits"].get(name, 0) == max(0, 25 - len(holders))
    assert report["by_behaviour"] == {b: sum(r[3] == b for r in clips.values()) for b in ("b0", "b1", "b2")}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_broken_arrays_and_strict_lines(spark, tmp_path):
    np.savez(tmp_path / "a.npz", cb0=[1, 2], energy=np.float32([0.5, 1]), f0=np.float32([0, 1]))
    (tmp_path / "b.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "c.npz", cb0=[1])
    found = {os.path.basename(r.path): r for r in codec.read_npz(spark, str(tmp_path)).collect()}
    assert found["a.npz"].cb0 == [1, 2] and found["a.npz"].error is None and found["b.npz"].cb0 is None and found["b.npz"].error and found["c.npz"].error
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{nope\n')
    assert storage.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        storage.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int", strict=True).collect()


def test_checkpoint_modes(spark):
    saved = spark.createDataFrame([("p1", "", 1), ("p1", "step9", 9), ("p1", "final", 5), ("p2", "step1", 1), ("p2", "step2", 2)], "folder string, tag string, at int")
    of = lambda mode: rows_of(storage.checkpoints(saved, mode), "folder", "tag")
    assert of("final") == [("p1", "final"), ("p2", "step2")] and of("single") == [("p1", "")] and len(of("all")) == 4
    with pytest.raises(ValueError):
        of("other")


def test_plans_read_the_tables(spark):
    """No planning query runs on fixed input alone, and the learning rate of every step is the plain formula's."""
    import math

    from turnlake.plans.catalog import queries

    folder = "/root/testdata/sf0.001"
    for name in ("plan_total", "plan_build", "plan_summary", "plan_partition_md5", "plan_index_spans", "plan_range_overlap", "plan_prompts", "plan_warmup_cosine"):
        assert queries()[name](spark, folder).inputFiles(), name
    rows = queries()["plan_warmup_cosine"](spark, folder).collect()
    totals = {}
    for r in rows:
        totals[r.run_id] = max(totals.get(r.run_id, 0), r.step + 1)
    for r in rows:
        total, warm = totals[r.run_id], totals[r.run_id] // 10
        plain = r.step / max(1, warm) if r.step < warm else 0.5 * (1 + math.cos(math.pi * min(1, (r.step - warm) / max(1, total - warm))))
        assert abs(r.rate - plain) < 1e-6


def test_numbered_by_blocks(spark):
    """Packs and workers as one order of all items would give them, whatever the blocks; null keys come first."""
    from turnlake.operators import storage as W

    names = sorted(f"{k % 7}item{k:04d}" for k in range(200))
    items = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    for block in (None, F.substring("name", 1, 1), F.lit(0)):
        found = {r.name: (r.pack, r.worker) for r in W.round_robin(W.packed(items, "name", 3, 10, block), "name", 4, block).collect()}
        assert found == {n: (k // 3, k % 4) for k, n in enumerate(names)}
    odd = spark.createDataFrame([("b",), (None,), ("a",)], "name string")
    assert [r["name"] for r in W.numbered(odd, "name", F.substring("name", 1, 8)).orderBy("place").collect()] == [None, "a", "b"]
    assert W.packed(odd.limit(0), "name", 3, 10).count() == 0
