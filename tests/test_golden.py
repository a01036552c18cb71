"""Published values that results must equal."""

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from turnlake.functions.exprs import half_even, md5_mod, rank_floor, script_ok, word_count
from turnlake.functions.vocab import FLAGS
from turnlake.operators import evaluation as E
from turnlake.operators import frames as G
from turnlake.operators import quality as Q
from turnlake.plans.allocation import default_plan
from turnlake.plans.catalog import queries
from turnlake.sources import codec


def test_default_plan(spark):
    plan = default_plan(spark).cache()
    total = plan.agg(F.count(F.lit(1)), F.sum("count"), F.sum(F.when(F.col("force_silence"), F.col("count")))).first()
    assert tuple(total) == (390, 9009, 381)
    by = {r.behaviour: r.n for r in plan.groupBy("behaviour").agg(F.sum("count").alias("n")).collect()}
    assert by["endpoint_end"] == 1297 and by["overlap_coop"] == 542 and by["incomplete_thinking"] == 898 and by["backchannel"] == 1080
    by = {r.gender: r.n for r in plan.groupBy("gender").agg(F.sum("count").alias("n")).collect()}
    assert by == {"female": 4466, "male": 4543}


def test_scalars(spark):
    row = spark.range(1).select(
        half_even(F.lit(2.5)), half_even(F.lit(3.5)), half_even(F.lit(0.5)), md5_mod(F.lit("a|b|c"), 8), md5_mod(F.lit("a|b|c"), 200), md5_mod(F.lit("a|b|c"), 7),
        rank_floor(F.array(*map(F.lit, [3, 1, 2, 10])), 0.9), word_count(F.lit(" a b  c ")), script_ok(F.lit("12"), F.lit("hi"))).first()
    assert tuple(row) == (2, 4, 0, 6, 134, 2, 10, 3, True)
    frames = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 4, 6, 7, 8, 10, 11)], "n int").select(G.audio_frames(F.col("n"))).collect()]
    assert frames == [6, 23, 34, 40, 45, 57, 62]


def test_point_event_reverts_to_base(spark):
    """A point event lasts one frame and then the base holds, not the sustained flag before it."""
    scenarios = spark.createDataFrame([("a", "one two three", "NAPPING"), ("b", "", "TTS_SPEAKING")], "scenario_id string, user_text string, agent_state string")
    targets = spark.createDataFrame([("a", 0, 2, "INCOMPLETE", ""), ("a", 1, 5, "TURN_END", ""), ("a", 2, 5, "COMMIT_LLM", "")], "scenario_id string, ord int, frame_offset int, flag string, spoken_text string")
    grid = {r.scenario_id: r for r in G.grid(G.lengths(G.with_events(scenarios, targets))).collect()}
    flags = grid["a"].flags
    assert flags[:2] == ["LISTEN"] * 2 and flags[2:5] == ["INCOMPLETE"] * 3 and flags[5] == "COMMIT_LLM" and flags[6] == "LISTEN"
    assert grid["a"].states[4:6] == ["IDLE", "LLM_GEN"]
    # an empty timeline is one LISTEN at frame 0, whatever the agent does
    assert set(grid["b"].flags) == {"LISTEN"} and set(grid["b"].states) == {"TTS_SPEAKING"}
    assert len(flags) == grid["a"].num_frames == 25


def test_char_to_time(spark):
    """Before the first word its start; on the space between words the end of the last one."""
    words = [("hi", 0.5, 0.9, 2, 3), ("you", 1.0, 1.6, 5, 7)]
    df = spark.createDataFrame([(c, words) for c in (0, 2, 3, 4, 6)], "c int, words array<struct<text:string,start_s:double,end_s:double,start_char:int,end_char:int>>")
    found = [round(r[0], 6) for r in df.select(G.char_to_time(F.col("words"), F.col("c"))).collect()]
    assert found == [0.5, 0.5, 0.9, 1.6, 1.3]
    none = df.select(G.char_to_time(F.array().cast(df.schema["words"].dataType), F.col("c"), F.lit(2.0), F.lit(8))).collect()
    assert [r[0] for r in none] == [0.0, 0.5, 0.75, 1.0, 1.5]


#: Eight published records: audio and window lengths, flags and states as (first frame, id), spoken frames.
SAMPLES = [
    ("sample_endpoint_en", "IDLE", 10, [(0, "LISTEN", ""), (18, "PREFETCH_LLM", ""), (24, "TURN_END", ""), (25, "COMMIT_LLM", "")], 57, 65, {18: 7, 24: 3, 25: 8}, 0, [(0, 0), (18, 1)], []),
    ("sample_backchannel_en", "TTS_DONE", 10, [(0, "LISTEN", ""), (20, "LISTEN", "right")], 57, 65, {}, 0, [(0, 3)], [(20, "right")]),
    ("sample_backchannel_silent_hi", "TTS_DONE", 12, [(0, "LISTEN", ""), (14, "LISTEN", "")], 68, 76, {}, 0, [(0, 3)], []),
    ("sample_barge_real_hi", "TTS_SPEAKING", 7, [(0, "HOLD", ""), (2, "BARGE_HARD", "")], 40, 48, {2: 5}, 1, [(0, 2), (2, 0)], []),
    ("sample_barge_lookalike_hi", "TTS_SPEAKING", 4, [(0, "HOLD", ""), (3, "CONTINUE", "")], 23, 31, {k: 6 for k in range(3, 31)}, 1, [(0, 2)], []),
    ("sample_incomplete_gu", "IDLE", 6, [(0, "LISTEN", ""), (16, "INCOMPLETE", "yes")], 34, 42, {k: 2 for k in range(16, 42)}, 0, [(0, 0)], [(16, "yes")]),
    ("sample_silence_break_en", "IDLE", 1, [(0, "LISTEN", ""), (40, "SILENCE_BREAK", "Are you still there?")], 6, 49, {40: 10}, 0, [(0, 0), (40, 2)], [(40, "Are you still there?")]),
    ("sample_correction_hi", "IDLE", 9, [(0, "LISTEN", ""), (12, "INCOMPLETE", ""), (26, "TURN_END", "")], 51, 59, {**{k: 2 for k in range(12, 26)}, 26: 3}, 0, [(0, 0), (26, 1)], []),
]


def test_published_records(spark):
    scenarios = spark.createDataFrame(
        [(s[0], "b", "l", "d", "", " ".join(["w"] * s[2]), s[1]) for s in SAMPLES], "scenario_id string, behaviour string, language string, domain string, agent_text string, user_text string, agent_state string")
    targets = spark.createDataFrame([(s[0], k, *e) for s in SAMPLES for k, e in enumerate(s[3])], "scenario_id string, ord int, frame_offset int, flag string, spoken_text string")
    none = spark.createDataFrame([], "scenario_id string, frame int, e double")
    found = {r.scenario_id: r for r in G.frame_records(G.lengths(G.with_events(scenarios, targets)), none).collect()}
    for name, _, _, _, audio, frames, flags, base, states, spoken in SAMPLES:
        r = found[name]
        assert (r.audio_frames, r.num_frames) == (audio, frames) and r.flags == [flags.get(k, base) for k in range(frames)]
        assert r.agent_state == [next(s for at, s in reversed(states) if at <= k) for k in range(frames)]
        assert [(s.frame, s.text) for s in r.spoken_spans] == spoken and r.speaking_mask == [int(k in dict(spoken)) for k in range(frames)]
        assert r.vad == [int(k < audio) for k in range(frames)]


def test_states_follow_painted_flags(spark):
    """A hidden event leads nowhere; events before the start are moved to it, those of one frame in list order."""
    scenarios = spark.createDataFrame([("a", "x", "IDLE", "endpoint_end"), ("b", "x", "IDLE", "endpoint_end")], "scenario_id string, user_text string, agent_state string, behaviour string")
    targets = spark.createDataFrame(
        [("a", 0, 5, "TURN_END", ""), ("a", 1, 5, "INCOMPLETE", ""), ("b", 0, -3, "PREFETCH_LLM", ""), ("b", 1, 4, "HOLD", "")], "scenario_id string, ord int, frame_offset int, flag string, spoken_text string")
    clips = G.with_events(scenarios, targets)
    grid = {r.scenario_id: r for r in G.grid(G.lengths(clips)).collect()}
    assert set(grid["a"].states) == {"IDLE"} and grid["a"].flags[5:] == ["INCOMPLETE"] * (len(grid["a"].flags) - 5)
    assert grid["b"].flags[:5] == ["PREFETCH_LLM", "LISTEN", "LISTEN", "LISTEN", "HOLD"] and set(grid["b"].states) == {"LLM_GEN"}
    moved = {r.scenario_id: [(e.frame_offset, e.ord) for e in r.events] for r in G.calibrated(clips, F.lit(2), G.primary_flag(F.col("behaviour"))).collect()}
    assert moved == {"a": [(2, 0), (2, 1)], "b": [(0, 0), (2, 1)]}


def test_words_of_characters(spark):
    chunks = [(list("hi y"), [0.0, 0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.4]), (list("ou !"), [0.4, 0.5, 0.6], [0.5, 0.6, 0.7, 0.8])]
    df = spark.createDataFrame([(chunks,)], "chunks array<struct<characters:array<string>,starts:array<double>,ends:array<double>>>")
    timeline = df.select(G.character_timeline(F.col("chunks")).alias("t"))
    assert [tuple(w) for w in timeline.select(G.words_of_characters(F.col("t")).alias("w")).first().w] == [("hi", 0.0, 0.2, 0, 1), ("you", 0.3, 0.6, 3, 5)]


def test_json_in_prose(spark):
    texts = ["```json\n{\"a\": 1}\n```", "say {\"b\": 2} so", "{\"c\": 3}", "none", "{broken"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Q.json_in_prose(F.col("t"))).collect()]
    assert found == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None, None]


def test_wav_and_npz(spark, tmp_path):
    t = np.arange(16000) / 16000
    sound = (np.sin(2 * np.pi * 200 * t) * 16000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000), f.writeframes(sound.tobytes())
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in codec.read_wavs(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].duration_s == 1.0 and len(rows["a.wav"].energy) == 9 and rows["b.wav"].error
    rate, samples = codec.decode_wav((tmp_path / "a.wav").read_bytes())
    assert abs(codec.pitch(samples[:3200], rate) - 200) < 2
    buffer = io.BytesIO()
    np.savez(buffer, cb0=np.arange(3), energy=np.ones(3, "f4"), f0=np.zeros(3, "f4"))
    (tmp_path / "c.npz").write_bytes(buffer.getvalue())
    assert codec.read_npz(spark, str(tmp_path)).first().cb0 == [0, 1, 2]
    assert {r.name for r in codec.inventory(spark, str(tmp_path)).collect()} == {"a.wav", "b.wav"}


def test_json_lines(spark, tmp_path):
    from turnlake.operators.storage import read_json_lines, write_shards

    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n{"id": "c", ')
    rows = read_json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int")
    assert sorted((r.id, r.n) for r in rows.collect()) == [("a", 1), ("b", 2)]
    write_shards(spark.range(10).coalesce(1), str(tmp_path / "out"), 4)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_vocabulary():
    assert FLAGS.index("BARGE_HARD") == 5 and len(FLAGS) == 11


def test_moving_average_needs_no_list(spark):
    """The fold over a long run, from sums that need no run in one row; a null leaves no average."""
    values = [(7 * k) % 101 - 50.0 for k in range(3000)]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", 0, 4.0), ("c", 0, 1.0), ("c", 1, None)], "run string, step int, x double")
    found = E.moving_average(rows, "run", ["step"], "x")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + (1 - 0.9) * v
    got = {r.run: r.ema for r in found.collect()}
    assert abs(got["a"] - want) < 1e-9 and got["b"] == 4.0 and got["c"] is None


def test_whole_clips(spark):
    """Registered over whole clips too, beside the queries of the first 40 and 50 frames."""
    folder = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{folder}/events.parquet").count()
    assert queries()["eval_best_checkpoint_whole"](spark, folder).count() == every
    assert queries()["eval_moving_average_whole"](spark, folder).count() == queries()["eval_moving_average"](spark, folder).count()
