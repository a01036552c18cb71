"""What goes out beside the clips: paths that keep folders small, metadata, the flat cost file, the next round's config, files
by name, and sound files put together by expressions."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import llm_cost, md5_mod, tts_cost

#: Folders that clips are spread over by the hash of their id.
FOLDERS = 200
METADATA = "file_name string, text string, scenario_id string"
#: The columns of the cost file, in their order (fixed values).
COST_FILE = ("kind string, run_id string, stage string, job_key_or_scenario string, model string, requested_or_chars long, valid_or_duration_s double,"
             " prompt_tokens long, completion_tokens long, cost_usd double, latency_ms double, status string, error string, created_at double")


def _in_folder(head: str, key: Column, end: str) -> Column:
    return F.format_string(f"{head}/%03d/%s{end}", md5_mod(key, FOLDERS), key)


def audio_path(key: Column) -> Column:
    """Where a clip's sound goes: one of FOLDERS folders, by the hash of its id."""
    return _in_folder("audio", key, ".wav")


def timestamps_path(key: Column) -> Column:
    return _in_folder("timestamps", key, ".json")


def encoded_path(language: Column, name: Column) -> Column:
    """Where an encoded clip goes: a folder by the first two digits of the id that ends its name."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat_ws("/", F.lit("encoded"), language, F.substring(F.right(stem, F.lit(16)), 1, 2), name)


def write_metadata(clips: DataFrame, path: str, key: str = "scenario_id", text: str = "text") -> None:
    """The clips' paths and texts, as JSON lines in metadata.jsonl and with a header in metadata.csv.

    A null text is null in one and empty in the other; texts may hold quotes and line ends.
    """
    rows = clips.select(audio_path(F.col(key)).alias("file_name"), F.col(text).alias("text"), F.col(key).alias("scenario_id"))
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/metadata.jsonl")
    rows.fillna("", ["text"]).write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/metadata.csv")


def read_metadata(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """(file_name, text, scenario_id) of either file."""
    if kind == "jsonl":
        return spark.read.schema(METADATA).json(f"{path}/metadata.jsonl")
    rows = spark.read.schema(METADATA).options(header=True, escape='"', multiLine=True).csv(f"{path}/metadata.csv")
    return rows.fillna("", ["text"])


def cost_rows(calls: DataFrame, renders: DataFrame, runs: DataFrame, voice_model: str = "tts") -> DataFrame:
    """Both logs as COST_FILE has them: calls, then renderings, of runs that are known, with their stage."""
    none = F.lit(None)
    a = calls.join(runs.select("run_id", "stage"), "run_id").select(
        F.lit("llm"), "run_id", "stage", "job_key", "model", "requested_n", "valid_n", "prompt_tokens", "completion_tokens",
        llm_cost(F.col("prompt_tokens"), F.col("completion_tokens")), "latency_ms", "status", "error", "created_at")
    b = renders.join(runs.select("run_id", "stage"), "run_id").select(
        F.lit("tts"), "run_id", "stage", "scenario_id", F.lit(voice_model), "chars", "duration_s", none, none,
        tts_cost(F.col("chars"), F.col("duration_s")), "latency_ms", "status", "error" if "error" in renders.columns else none, "created_at")
    names = [c.split() for c in COST_FILE.split(", ")]
    return a.union(b).toDF(*[n for n, _ in names]).select(*[F.col(n).cast(kind) for n, kind in names])


def write_costs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COST_FILE).options(header=True, escape='"', multiLine=True).csv(path)


def topup_config(short: DataFrame, shares: DataFrame, least_clips: int, template: dict | None = None, tag: str = "topup", db_path: str = "data/runs_topup.db") -> DataFrame:
    """One row, one column config: a YAML text that asks for what is short and no more; no row if nothing is.

    short (name, short) and shares (behaviour, share) have a row a flag and a behaviour. The hours cover the largest
    deficit; the template's other values, of any JSON type, stay. tag tells the new ids from all there are.
    """
    base = dict(template or {})
    seconds = float(base.get("avg_window_seconds", 5.5))
    flags = short.agg(F.max("short").alias("need"), F.array_sort(F.collect_list(F.struct("name", "short"))).alias("flags"))
    parts = shares.agg(F.array_sort(F.collect_list(F.struct("behaviour", "share"))).alias("shares"))
    hours = F.greatest(F.lit(0.1), F.round(F.col("need") * seconds / 3600, 2))
    listed = F.array_join(F.transform("shares", lambda s: F.format_string("\n  %s: %.4f", s["behaviour"], s["share"])), "")
    values = {k: F.lit(json.dumps(v, ensure_ascii=False)) for k, v in base.items()} | {
        "total_hours": F.format_string("%.2f", hours), "avg_window_seconds": F.lit(json.dumps(seconds)), "behaviour_shares": F.when(F.size("shares") == 0, F.lit("{}")).otherwise(listed),
        "db_path": F.lit(json.dumps(db_path)), "corpus_tag": F.lit(json.dumps(tag))}
    said = F.array_join(F.transform("flags", lambda f: F.format_string("#   %s: %d\n", f["name"], f["short"])), "")
    head = F.concat(F.lit(f"# Clips that flags lack up to {least_clips}:\n"), said)
    lines = [F.concat(F.lit(f"{k}:"), F.when(v.startswith("\n"), "").otherwise(" "), v, F.lit("\n")) for k, v in values.items()]
    return flags.join(F.broadcast(parts)).where("need is not null").select(F.concat(head, *lines).alias("config"))  # one row each


def write_text(one: DataFrame, path: str) -> None:
    """A table of one text as a folder with one file."""
    one.coalesce(1).write.mode("overwrite").text(path)


def _named(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                path = posixpath.join(root, name)
                above = posixpath.dirname(path)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                part = posixpath.join(above, f".{uuid.uuid4().hex}")
                with system.open_output_stream(part) as out:
                    out.write(body or b"")
                system.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b or b"") for b in batch.column(1).to_pylist()], pa.int64())], ["name", "bytes"])

    return run


def write_named(rows: DataFrame, folder: str, name: str = "name", body: str = "body") -> DataFrame:
    """(name, bytes): each row's body as a file of that name below the folder, written by tasks.

    A file shows under its name when it is whole; a task that runs again writes the same once more. Names must be different.
    The result does the writing and must be written or counted once.
    """
    return rows.select(F.col(name).cast("string").alias("name"), F.col(body).cast("binary").alias("body")).mapInArrow(_named(folder), "name string, bytes long")


def _low_first(x: Column, size: int) -> Column:
    """An integer's lowest bytes, the lowest first, as hex digits."""
    digits = F.right(F.concat(F.lit("0" * 2 * size), F.hex(x.cast("long"))), F.lit(2 * size))
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def wav_bytes(samples: Column, rate: int) -> Column:
    """A sound file of one channel of 16 bits from an array of samples within -1 and 1; louder ones are cut."""
    values = F.transform(samples, lambda x: F.least(F.lit(32767), F.greatest(F.lit(-32768), F.bround(x.cast("double") * 32768, 0).cast("int"))))
    data = F.array_join(F.transform(values, lambda v: _low_first(v, 2)), "")
    size = F.size(samples) * 2
    fixed = lambda *numbers: "".join(n.to_bytes(k, "little").hex() for n, k in numbers)
    layout = b"fmt ".hex() + fixed((16, 4), (1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2)) + b"data".hex()
    return F.unhex(F.concat(F.lit(b"RIFF".hex()), _low_first(size + 36, 4), F.lit(b"WAVE".hex() + layout), _low_first(size, 4), data))


def joined_chunks(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, data): what a message stream's base64 chunks hold together, in their order; broken and null chunks hold nothing."""
    part = F.coalesce(F.try_to_binary(F.col(chunk), F.lit("base64")), F.lit(b""))
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.hex(part).alias("part")))).alias("parts"))
    return parts.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("data"))


def whole_wav(data: Column) -> Column:
    """A streamed sound file, whose sizes were open, with the sizes it turned out to have; other bytes as they are.

    The data's chunk must begin within the first 128 bytes, as it does where nothing but the format stands before it.
    """
    digits = F.hex(data)
    before = F.regexp_extract(F.substring(digits, 1, 256), f"^((?:..)+?){b'data'.hex()}", 1)
    at = F.length(before) + 1  # the first digit of the chunk's name
    streamed = (F.length(data) >= 44) & digits.startswith(b"RIFF".hex()) & (F.substring(digits, 17, 8) == b"WAVE".hex()) & (at > 24)
    size = F.length(data) - ((at - 1) / 2).cast("int") - 8
    whole = F.concat(F.substring(digits, 1, 8), _low_first(F.length(data) - 8, 4), F.substr(digits, F.lit(17), at - 9), _low_first(size, 4), F.substr(digits, at + 16))
    return F.when(streamed, F.unhex(whole)).otherwise(data)
