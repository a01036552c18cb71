"""Paths, metadata, cost files, configs, named files and sound files by expressions; words of characters and tolerant scores by brute force."""

import base64
import csv
import glob
import hashlib
import io
import os
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.functions.vocab import FLAGS
from turnlake.operators import audits, evaluation, frames, storage
from turnlake.sources import codec
from turnlake.sources import deliveries as D


def one(spark, value, kind, of):
    return spark.createDataFrame([(value,)], f"v {kind}").select(of(F.col("v"))).first()[0]


def test_paths(spark):
    for key in ("a", "clip_17", "नमस्ते"):
        folder = f"{int(hashlib.md5(key.encode()).hexdigest(), 16) % 200:03d}"
        assert one(spark, key, "string", D.audio_path) == f"audio/{folder}/{key}.wav"
        assert one(spark, key, "string", D.timestamps_path) == f"timestamps/{folder}/{key}.json"
    for name in ("src_0123456789abcdef.npz", "a.b_fedcba9876543210.npz", "short.npz", "none"):
        stem = name.rsplit(".", 1)[0]
        assert one(spark, name, "string", lambda c: D.encoded_path(F.lit("hi"), c)) == f"encoded/hi/{stem[-16:][:2]}/{name}"


def test_metadata_of_any_text(spark, tmp_path):
    texts = ["plain", 'a "quoted", text', "two\nlines", "crlf\r\nend ", "  spaces  ", "", None, "back\\slash", "नमस्ते", '"', "#x", "a,b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(F.col("id").cast("string").alias("scenario_id"), "text")
    D.write_metadata(rows, str(tmp_path))
    for kind, empty in (("jsonl", None), ("csv", "")):
        found = {int(r.scenario_id): r.text for r in D.read_metadata(spark, str(tmp_path), kind).collect()}
        assert found == {k: empty if t is None else t for k, t in enumerate(texts)}
    held = {}
    for path in glob.glob(f"{tmp_path}/metadata.csv/part-*"):
        with open(path, newline="", encoding="utf-8") as f:
            held |= {int(r["scenario_id"]): r["text"] for r in csv.DictReader(f)}
    assert held == {k: t or "" for k, t in enumerate(texts)}
    D.write_metadata(rows.limit(0), str(tmp_path))
    assert D.read_metadata(spark, str(tmp_path)).count() == 0 == D.read_metadata(spark, str(tmp_path), "csv").count()


def test_cost_file(spark, tmp_path):
    calls = spark.createDataFrame([("r1", "a|b", "m", 12, 3, 100, 200, 5.5, None, 'x "y", z', 1.5), ("gone", "c", "m", 1, 1, 1, 1, 1.0, "ok", None, 2.0)],
                                  "run_id string, job_key string, model string, requested_n long, valid_n long, prompt_tokens long, completion_tokens long, latency_ms double, status string, error string, created_at double")
    renders = spark.createDataFrame([("r1", "s1", 40, 2.5, 7.0, "ok", 3.0)], "run_id string, scenario_id string, chars long, duration_s double, latency_ms double, status string, created_at double")
    runs = spark.createDataFrame([("r1", "generate")], "run_id string, stage string")
    D.write_costs(D.cost_rows(calls, renders, runs, "voice"), str(tmp_path / "c"))
    a, b = sorted(D.read_costs(spark, str(tmp_path / "c")).collect(), key=lambda r: r.kind)
    assert (a.job_key_or_scenario, a.valid_or_duration_s, a.status, a.error, a.stage) == ("a|b", 3.0, None, 'x "y", z', "generate")
    assert a.cost_usd == pytest.approx((100 * 0.108 + 200 * 0.398) / 1e6)
    assert (b.model, b.requested_or_chars, b.prompt_tokens, b.error) == ("voice", 40, None, None)


def test_topup_config(spark, tmp_path):
    short = spark.createDataFrame([("TURN_END", 900), ("BARGE_HARD", 40)], "name string, short long")
    shares = spark.createDataFrame([("endpoint_end", 0.75), ("barge_real", 0.25)], "behaviour string, share double")
    text = D.topup_config(short, shares, 1000, {"llm": "m", "total_hours": 99, "nested": {"a": [1, 2]}}).first()[0]
    assert text == (
        '# Clips that flags lack up to 1000:\n#   BARGE_HARD: 40\n#   TURN_END: 900\nllm: "m"\ntotal_hours: 1.38\nnested: {"a": [1, 2]}\n'
        'avg_window_seconds: 5.5\nbehaviour_shares:\n  barge_real: 0.2500\n  endpoint_end: 0.7500\ndb_path: "data/runs_topup.db"\ncorpus_tag: "topup"\n')
    little = D.topup_config(spark.createDataFrame([("TURN_END", 1)], short.schema), shares.limit(0), 5)
    assert "total_hours: 0.10\n" in little.first()[0] and "behaviour_shares: {}\n" in little.first()[0]
    assert D.topup_config(short.limit(0), shares, 5).count() == 0
    D.write_text(D.topup_config(short, shares, 1000), str(tmp_path / "t"))
    [path] = glob.glob(f"{tmp_path}/t/part-*")
    with open(path, encoding="utf-8") as f:
        assert f.read().rstrip("\n") == D.topup_config(short, shares, 1000).first()[0].rstrip("\n")


def test_files_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{k}.bin", bytes([k]) * k) for k in range(5)] + [("b.bin", None)], "name string, body binary")
    for _ in range(2):
        found = {r.name: r.bytes for r in D.write_named(rows, f"file://{tmp_path}").collect()}
        assert found == {f"a/{k}.bin": k for k in range(5)} | {"b.bin": 0}
        assert sorted(os.path.relpath(p, tmp_path) for p in glob.glob(f"{tmp_path}/**/*", recursive=True) if os.path.isfile(p)) == sorted(found)
        assert not [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith(".")]
    assert (tmp_path / "a/3.bin").read_bytes() == b"\x03" * 3


def test_wav_by_expressions(spark):
    samples = [0.0, 0.5, -0.5, 1.0, -1.0, 3.0, -3.0, 1e-5, 0.25]
    data = bytes(one(spark, samples, "array<double>", lambda c: D.wav_bytes(c, 16_000)))
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (16_000, 1, 2, len(samples))
    rate, read = codec.decode_wav(data)
    assert rate == 16_000 and np.allclose(read, np.clip(samples, -1, 32767 / 32768), atol=1 / 32768)
    assert len(one(spark, [], "array<double>", lambda c: D.wav_bytes(c, 8000))) == 44
    assert one(spark, None, "array<double>", lambda c: D.wav_bytes(c, 8000)) is None

    streamed = data[:4] + b"\xff" * 4 + data[8:40] + b"\xff" * 4 + data[44:]
    assert bytes(one(spark, streamed, "binary", D.whole_wav)) == data
    extra = data[:12] + b"LIST" + (4).to_bytes(4, "little") + b"abcd" + data[12:]
    mended = bytes(one(spark, extra, "binary", D.whole_wav))
    assert mended == extra[:4] + (len(extra) - 8).to_bytes(4, "little") + extra[8:]
    for other in (b"", b"RIFF", b"x" * 60, data[:43]):
        assert bytes(one(spark, other, "binary", D.whole_wav)) == other
    assert one(spark, None, "binary", D.whole_wav) is None


def test_chunks(spark):
    data, rng = {}, random.Random(2)
    rows = []
    for key in range(5):
        parts = [rng.randbytes(rng.randrange(50)) for _ in range(key * 3)]
        data[key] = b"".join(parts)
        rows += [(key, k, base64.b64encode(p).decode()) for k, p in enumerate(parts)]
    rows += [(9, 0, None), (9, 1, "####"), (9, 2, base64.b64encode(b"ok").decode())]
    rng.shuffle(rows)
    found = D.joined_chunks(spark.createDataFrame(rows, "k int, at int, chunk string"), "k", "at", "chunk")
    assert {r.k: bytes(r.data) for r in found.collect()} == {k: v for k, v in data.items() if k} | {9: b"ok"}


def test_strict_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(r.a for r in storage.read_json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        storage.read_json_lines(spark, str(tmp_path), "a int", strict=True).collect()


def test_rendered_hours(spark):
    scenarios = spark.createDataFrame([("a", "long", "one two"), ("b", None, ""), ("c", "", "x y z"), ("d", "long", None)], "scenario_id string, length_band string, user_text string")
    cars = spark.createDataFrame([("a", 4.0), ("c", 0.0), ("b", None), ("zz", 9.0)], "scenario_id string, duration_s double")
    found = {r.band: tuple(r)[1:] for r in audits.rendered_hours(scenarios, cars).select("band", "n", "rendered", "real_s", "projected_s").collect()}
    assert found == {"long": (2, 1, 4.0, round(4 + 1 / 2.2, 4)), "short": (2, 0, 0.0, round(4 / 2.2, 4)), "total": (4, 1, 4.0, round(4 + 5 / 2.2, 4))}


def test_words_of_characters(spark):
    rng = random.Random(5)
    texts = ["", " ", "a", " a", "a ", "ab  cd", "\tx\n", None] + ["".join(rng.choice("ab  \t　é") for _ in range(rng.randrange(40))) for _ in range(40)]
    rows = [(k, None if t is None else [(c, float(i), i + 1.0) for i, c in enumerate(t)]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, cs array<struct<c:string,start_s:double,end_s:double>>")
    for r in df.select("k", frames.words_of_characters(F.col("cs")).alias("w")).collect():
        text, want, i = texts[r.k], [], 0
        while text is not None and i < len(text):
            j = i
            while j < len(text) and not text[j].isspace():
                j += 1
            if j > i:
                want.append((text[i:j], float(i), float(j), i, j - 1))
            i = max(j, i + 1)
        assert (r.w is None) if text is None else ([tuple(w) for w in r.w] == want)


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_tolerant_by_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    rows = [(c, k, rng.choice([None, 11, *range(11)]), rng.choice([None, *range(11)]), rng.random() < 0.8) for c in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "clip int, frame int, flag int, pred int, valid boolean")
    found = {r.flag: (r.precision, r.recall, r.f1) for r in evaluation.tolerant(df, tolerance).collect()}
    near = lambda c, k, at, x: any(q[0] == c and abs(q[1] - k) <= tolerance and q[4] and q[at] == x for q in rows)
    for x in range(len(FLAGS)):
        t, p = ([q for q in rows if q[4] and q[at] == x] for at in (2, 3))
        hit, right = sum(near(q[0], q[1], 3, x) for q in t), sum(near(q[0], q[1], 2, x) for q in p)
        a, b = right / len(p) if p else 0.0, hit / len(t) if t else 0.0
        assert found[x] == pytest.approx((a, b, 2 * a * b / (a + b) if a + b else 0.0))
    assert len(found) == len(FLAGS)
    assert evaluation.tolerant(df.limit(0)).count() == 0
