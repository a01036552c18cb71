"""Sessions as state, chained stages, the monitor, appends, viewer files, packs and pitch tracks."""

import glob
import io
import json
import os
import random
import tempfile
import wave

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnlake.functions.vocab import FLAGS
from turnlake.operators.logs import orchestrated
from turnlake.sources import codec, packs, viewer
from turnlake.sources.ledger import Ledger, RunLog
from turnlake.streaming import floor
from turnlake.streaming import live as V
from turnlake.streaming.monitor import Monitor
from turnlake.streaming.stages import Stages

START = 1_700_000_000_000_000


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="turnlake-test-")


@pytest.fixture(scope="module")
def steps(spark):
    rng, rows = random.Random(4), []
    for session in range(7):
        at = START + rng.randrange(10_000_000)
        for k in range(rng.choice([1, 40, 160])):
            at += rng.choice([0, 80_000, 80_000, 2_400_000, 2_500_000, 2_500_001, 9_000_000])
            rows.append((session, at, 1000 * session + k, rng.choice(FLAGS), rng.choice(["IDLE", "LLM_GEN", None]), rng.choice(["", None, "ok"]), rng.random()))
    df = spark.createDataFrame(rows, "user_id long, at_us long, event_id long, flag string, agent_state string, spoken string, value double")
    return df.withColumn("ts", F.timestamp_micros("at_us")).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("files_a_batch", [1, 3, 20])
def test_sessions_over_any_batches(spark, steps, folder, files_a_batch):
    late = V.arrivals(steps.drop("at_us"), "ts", "user_id", 6, f"{folder}/in")
    stream = V.stream_of(spark, f"{folder}/in", files_a_batch)
    found = V.drained(floor.orchestrator(stream, "user_id", "ts", late), "floor").where("session >= 0")
    columns = ("at_us", "event_id", "flag", "prefetch_active", "actions")
    batch = orchestrated(steps, "user_id", "at_us", "event_id")
    assert rows_of(found, "session", *columns) == rows_of(batch, "user_id", *columns)
    assert found.where("event_id is null and flag = 'SILENCE_BREAK'").count() > 20

    if files_a_batch != 3:
        return
    spoken = V.drained(floor.referee(V.stream_of(spark, f"{folder}/in", files_a_batch), "user_id", "ts", late, trailing=5), "referee").where("session >= 0")
    want, rows = [], {}
    for r in sorted(steps.collect(), key=lambda r: (r.at_us, r.event_id)):
        rows.setdefault(r.user_id, []).append(r)
    for session, own in rows.items():
        want += [(session, r.event_id, bool(r.value > np.mean([x.value for x in own[max(0, k - 4):k + 1]]))) for k, r in enumerate(own)]
    assert rows_of(spoken, "session", "event_id", "speaking") == sorted(want, key=repr)


def test_silence_is_broken_while_no_frame_comes(spark, folder):
    """The timer fires before any further frame of the session is there."""
    one = lambda user, s: spark.createDataFrame([(user, s, user, "LISTEN", "IDLE", "")], "user_id long, s double, event_id long, flag string, agent_state string, spoken string").withColumn(
        "ts", F.timestamp_micros((F.lit(START) + F.col("s") * 1e6).cast("long"))).drop("s")
    one(1, 0.0).write.mode("append").parquet(f"{folder}/in")
    one(2, 60.0).write.mode("append").parquet(f"{folder}/in")
    found = V.drained(floor.orchestrator(V.stream_of(spark, f"{folder}/in", 1), "user_id", "ts", "1 second"), "quiet")
    assert rows_of(found.where("session = 1"), "at_us", "flag") == [(START, "LISTEN"), (START + 2_500_000, "SILENCE_BREAK")]


def test_stages_restart_anywhere(spark, folder):
    works = [("a", lambda df: df.where("x >= 0")), ("b", lambda df: df.withColumn("y", F.col("x") * 2)), ("c", lambda df: df.where("y % 4 = 0").select("y"))]
    schema = spark.range(1).select(F.col("id").alias("x")).schema
    put = lambda low, high: spark.range(low, high).select(F.col("id").alias("x")).write.mode("append").parquet(f"{folder}/incoming")
    make = lambda: Stages(spark, folder, schema, works, files_a_batch=2)
    make().sweep()
    assert make().result().count() == 0
    put(-5, 10)
    make().sweep(last=1)
    assert make().result(0).count() == 10 and make().result().count() == 0
    make().sweep(first=1, last=2)
    put(10, 20)
    for _ in range(3):
        make().sweep()
    assert rows_of(make().result(), "y") == [(y,) for y in sorted(range(0, 40, 4), key=lambda y: repr((y,)))]
    queries = make().every("1 second")
    put(20, 22)
    import time

    end = time.time() + 60
    while make().result().where("y = 40").count() == 0 and time.time() < end:
        time.sleep(1)
    for q in queries:
        q.stop()
        q.awaitTermination()
    assert make().result().where("y = 40").count() == 1


def test_monitor_writes_each_batch_once(spark, folder):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i * 1.5) for i in range(300)], "at long, kind string, value double")
    seen = Monitor(spark, f"{folder}/m", "kind", "value", ["at"])
    batches = [rows.where(f"at % 3 = {k}") for k in range(3)]
    seen(batches[0], 0)
    seen(batches[1], 1)
    seen(batches[1], 1)  # run again after its mark: nothing changes
    # a batch that failed before its mark leaves parts behind and is written anew
    batches[2].limit(7).write.json(f"{folder}/m/log/batch=2")
    assert seen.log(rows.schema).count() == 200 and seen.batches() == [0, 1]
    seen(batches[2], 2)
    seen(batches[0], 0)
    assert rows_of(seen.dashboard(), "kind", "n", "total") == rows_of(rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "kind", "n", "total")
    assert rows_of(seen.feed(), "at") == sorted(((i,) for i in range(252, 300)), key=repr)
    assert rows_of(seen.log(rows.schema), "at", "kind") == rows_of(rows, "at", "kind")


def test_appends_resume(spark, folder):
    log = RunLog(spark, folder, "job_key string, made int")
    rows = lambda *r: spark.createDataFrame(list(r), "job_key string, made int")
    assert log.appended().count() == 0
    assert log.start("r1", "scripts", {"size": 12}, {"limit": None}, 1.5, "h") and not log.start("r1", "scripts", {}, {}, 2.0, "h")
    assert log.append("r1", 0, rows(("a", 3), ("b", 2)))
    assert not log.append("r1", 0, rows(("a", 3), ("b", 2)))
    rows(("a", 100)).withColumn("run_id", F.lit("r1")).write.parquet(f"{folder}/rows/data/part=r1-000000001")  # killed before its mark
    left = log.remaining(spark.createDataFrame([("a", 10), ("b", 2), ("c", 4)], "job_key string, target int"))
    assert rows_of(left, "job_key", "left") == [("a", 7), ("b", 0), ("c", 4)]
    assert log.append("r1", 1, rows(("a", 7)))
    assert rows_of(log.appended(), "job_key", "made", "run_id") == [("a", 3, "r1"), ("a", 7, "r1"), ("b", 2, "r1")]
    header = log.headers().first()
    assert json.loads(header.config_snapshot) == {"size": 12} and header.stage == "scripts" and header.started_at == 1.5
    with pytest.raises(ValueError):
        Ledger(spark, folder).write("../x", rows(("a", 1)))


@pytest.mark.parametrize("n", [0, 1, 100, 101, 250])
def test_viewer_files(spark, folder, n):
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("wavs/"), "id").alias("audio"), (F.col("id") / 2).alias("duration_s")).repartition(3)
    viewer.write_viewer(spark.range(5).select("id"), folder, ["id"])  # an older set goes
    viewer.write_viewer(rows, folder, ["id"], rows_a_file=100, audio={"audio": 24000})
    files = -(-n // 100)
    local = folder.removeprefix("file://")
    if n == 0:
        assert not glob.glob(f"{local}/*.parquet")
        return
    assert sorted(os.path.basename(p) for p in glob.glob(f"{local}/*")) == [f"train-{k:05d}-of-{files:05d}.parquet" for k in range(files)]
    for k in range(files):
        t = pq.read_table(f"{local}/train-{k:05d}-of-{files:05d}.parquet")
        assert t["id"].to_pylist() == list(range(100 * k, min(n, 100 * k + 100)))
        about = json.loads(t.schema.metadata[b"huggingface"])["info"]["features"]
        assert about == {"id": {"dtype": "int64", "_type": "Value"}, "audio": {"sampling_rate": 24000, "_type": "Audio"}, "duration_s": {"dtype": "float64", "_type": "Value"}}


def test_a_failed_viewer_write_leaves_the_old_files(spark, folder):
    viewer.write_viewer(spark.range(5).select("id"), folder, ["id"])
    bad = spark.range(20).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(1).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        spark.dataSource.register(viewer.ViewerSource)
        bad.repartition(4).write.format("viewer").option("path", folder).option("features", "{}").mode("overwrite").save()
    assert sorted(os.listdir(folder.removeprefix("file://"))) == ["train-00000-of-00001.parquet"]


def test_packs(spark, folder):
    clip = {"scenario_id": "a", "behaviour": "x", "num_frames": 2, "cb0": [1, 2], "energy": [0.5, 1.0], "f0": [0.0, 1.0], "flags": [1, 1]}
    df = spark.createDataFrame([Row(**clip), Row(**{**clip, "scenario_id": "b"})], "scenario_id string, behaviour string, num_frames int, cb0 array<long>, energy array<float>, f0 array<float>, flags array<int>")
    spans = F.when(F.col("scenario_id") == "a", F.array(F.struct(F.lit(3).alias("frame"), F.lit("हाँ \"ok\"").alias("text")))).otherwise(F.array())
    packs.write_packs(packs.packed_clips(df, spans), folder)
    found = packs.read_packs(spark, folder)
    assert rows_of(packs.spans_of(found), "scenario_id", "ord", "frame", "text", "flag") == [("a", 0, 3, 'हाँ "ok"', None)]
    assert rows_of(packs.frames_of(found, "cb0", "flags"), "scenario_id", "frame", "cb0", "flags") == [(s, i, i + 1, 1) for s in "ab" for i in range(2)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    read = plan(packs.spans_of(found)).split("ReadSchema: ")[1]
    assert "spoken_spans" in read and "cb0" not in read and "energy" not in read
    read = plan(packs.frames_of(found, "cb0", "flags")).split("ReadSchema: ")[1]
    assert "cb0" in read and "flags" in read and "energy" not in read and "spoken_spans" not in read


def tone(hz, rate=8000, seconds=0.5):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def wav(samples, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


def slow_track(x, rate, hop, low=70.0, high=400.0):
    first, last, out = int(rate / high), int(rate / low), []
    for i in range(-(-len(x) // hop)):
        s = np.asarray(x[i * hop:(i + 1) * hop], float)
        out.append(0.0)
        if len(s) < last or np.sqrt((s * s).mean() + 1e-9) < 1e-3:
            continue
        s = s - s.mean()
        r = [float((s[:len(s) - k] * s[k:]).sum()) for k in range(last)]
        lag = max(range(first, last), key=lambda k: r[k])
        if r[0] > 0 and r[lag] / r[0] > 0.3:
            out[-1] = rate / lag
    return out


def test_pitch_of_values_of_any_shape(spark):
    rng = np.random.default_rng(0)
    mixed = np.concatenate([tone(200), np.zeros(900, np.float32), rng.normal(0, 0.2, 1700).astype(np.float32), tone(110), [0.1] * 77])
    hop = 640
    want = slow_track(mixed, 8000, hop)
    assert np.allclose(codec.pitch_track(mixed, 8000, hop), want) and np.allclose(codec.pitch_track(mixed, 8000, hop, rows=3), want)
    assert any(abs(x - 200) < 3 for x in want) and any(abs(x - 110) < 3 for x in want) and 0.0 in want

    clips = [("a", mixed.tolist()), ("none", None), ("empty", []), ("nan", [float("nan")] * 2000)]
    found = {r.id: r for r in codec.pitch_tracks(spark.createDataFrame(clips, "id string, audio array<float>"), "id", "audio", hop, 8000).collect()}
    assert np.allclose(found["a"].f0, want) and len(found["a"].energy) == len(want)
    assert found["none"].f0 is None and found["nan"].f0 is None and found["empty"].f0 == []

    whole = codec.decode_wav(wav(mixed))[1]
    sound = [("a", bytearray(wav(mixed))), ("broken", bytearray(b"RIFFxxxx")), ("none", None)]
    found = {r.id: r for r in codec.pitch_tracks(spark.createDataFrame(sound, "id string, audio binary"), "id", "audio", hop).collect()}
    assert np.allclose(found["a"].f0, slow_track(whole, 8000, hop)) and found["a"].rate == 8000 and found["broken"].f0 is None and found["none"].rate is None

    df = spark.createDataFrame([("a", (mixed.tolist(), 8000)), ("zero", ([0.1], 0))], "id string, audio struct<array: array<float>, sampling_rate: int>")
    found = {r.id: r for r in codec.pitch_tracks(df, "id", "audio", hop).collect()}
    assert np.allclose(found["a"].f0, want) and found["zero"].f0 is None
    df = spark.createDataFrame([("a", (bytearray(wav(mixed)), "x.wav"))], "id string, audio struct<bytes: binary, path: string>")
    assert np.allclose(codec.pitch_tracks(df, "id", "audio", hop).first().f0, slow_track(whole, 8000, hop))

    texts = [("list", json.dumps(mixed.tolist())), ("held", json.dumps({"array": mixed.tolist(), "sampling_rate": 8000})), ("odd", '{"path": "x"}'), ("text", '"x"'), ("null", None)]
    df = spark.createDataFrame(texts, "id string, t string").select("id", F.parse_json("t").alias("audio"))
    found = {r.id: r for r in codec.pitch_tracks(df, "id", "audio", hop, 8000).collect()}
    assert np.allclose(found["list"].f0, want) and np.allclose(found["held"].f0, want)
    assert all(found[k].f0 is None for k in ("odd", "text", "null"))
