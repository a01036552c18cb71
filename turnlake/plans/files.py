"""Queries of files that are written and read back: plans, sidecars, sound files, metadata, costs, the next round's config."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import publishing as P
from ..operators import quality as Q
from ..operators import storage as ST
from ..sources import codec, moves
from ..sources import deliveries as D
from ..sources.adapters import CALLS, FRAMES, RENDERS, SCENARIOS, adapted, oracle
from ..streaming.live import shared_path
from .audits import BRIDGE, SHORT
from .logs import COST, SPEECH
from .quality import WORDS
from .registry import query

C, R, S = oracle(CALLS), oracle(RENDERS), oracle(SCENARIOS)
BUCKET = "lpad(CAST(CAST(('0x' || md5({x})) AS UHUGEINT) % 200 AS VARCHAR), 3, '0')"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'audio/' || {BUCKET.format(x="CAST(doc_id AS VARCHAR)")} || '/' || doc_id || '.wav' AS audio,
  'timestamps/' || {BUCKET.format(x="CAST(doc_id AS VARCHAR)")} || '/' || doc_id || '.json' AS timestamps,
  'encoded/' || lang || '/' || left(right(source || '_' || md5(CAST(doc_id AS VARCHAR)), 16), 2) || '/' || source || '_' || md5(CAST(doc_id AS VARCHAR)) || '.npz' AS encoded
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def publish_paths(spark, d):
    """Where a clip's files go: by the hash of its id, and by the digits that end an encoded file's name."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL AND source IS NOT NULL")
    key = F.col("doc_id").cast("string")
    name = F.concat("source", F.lit("_"), F.md5(key.cast("binary")), F.lit(".npz"))
    return docs.select(key.alias("id"), D.audio_path(key).alias("audio"), D.timestamps_path(key).alias("timestamps"), D.encoded_path(F.col("lang"), name).alias("encoded"))


@query(f"""SELECT kind, 'audio/' || {BUCKET.format(x="CAST(doc_id AS VARCHAR)")} || '/' || doc_id || '.wav' AS file_name, CAST(doc_id AS VARCHAR) AS scenario_id,
  md5(coalesce(text, '')) AS digest FROM documents, (SELECT unnest(['jsonl', 'csv']) AS kind)""")
def publish_metadata(spark, d):
    """Metadata of whole texts in both of its files, read back."""
    path = shared_path(spark, "metadata")
    D.write_metadata(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("scenario_id"), "text"), path)
    read = [D.read_metadata(spark, path, kind).withColumn("kind", F.lit(kind)) for kind in ("jsonl", "csv")]
    return read[0].unionByName(read[1]).select("kind", "file_name", "scenario_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


RUNS = f"SELECT DISTINCT run_id, CASE WHEN run_id IN ('run0', 'run2') THEN 'generate' ELSE 'render' END AS stage FROM ({CALLS}) WHERE run_id <> 'run4'"


@query(f"""WITH u AS ({oracle(RUNS)}), c AS (SELECT *, {COST} AS cost_usd FROM ({C})), r AS (SELECT *, {SPEECH} AS cost_usd FROM ({R}))
SELECT 'llm' AS kind, run_id, stage, job_key AS item, 'm1' AS model, CAST(requested_n AS BIGINT) AS amount, CAST(valid_n AS DOUBLE) AS done, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, round(cost_usd, 9) AS cost_usd,
  round(latency_ms, 6) AS latency_ms, status, error, round(created_at, 3) AS created_at FROM c JOIN u USING (run_id)
UNION ALL SELECT 'tts', run_id, stage, scenario_id, 'v1', CAST(chars AS BIGINT), duration_s, NULL, round(cost_usd, 9), round(latency_ms, 6), status, NULL, round(created_at, 3) FROM r JOIN u USING (run_id)""")
def ops_cost_file(spark, d):
    """The flat cost file of both logs, written and read back."""
    path = shared_path(spark, "costs")
    calls = adapted(spark, d, CALLS).withColumn("model", F.lit("m1"))
    D.write_costs(D.cost_rows(calls, adapted(spark, d, RENDERS), adapted(spark, d, RUNS), "v1"), path)
    rounded = {"cost_usd": F.round("cost_usd", 9), "latency_ms": F.round("latency_ms", 6), "created_at": F.round("created_at", 3)}
    rows = D.read_costs(spark, path).withColumnsRenamed({"job_key_or_scenario": "item", "requested_or_chars": "amount", "valid_or_duration_s": "done"}).withColumns(rounded)
    return rows.select("kind", "run_id", "stage", "item", "model", "amount", "done", "prompt_tokens", "cost_usd", "latency_ms", "status", "error", "created_at")


@query(f"""WITH {SHORT}, {BRIDGE}, p AS (SELECT *, weight / CAST(sum(weight) OVER (PARTITION BY name) AS DOUBLE) AS part FROM b),
n AS (SELECT behaviour, sum(short * part) AS need FROM sh JOIN p USING (name) GROUP BY 1), x AS (SELECT behaviour, round(need / sum(need) OVER (), 4) AS share FROM n)
SELECT '# Clips that flags lack up to 200:' || chr(10) || (SELECT string_agg('#   ' || name || ': ' || short || chr(10), '' ORDER BY name) FROM sh) || 'avg_window_seconds: 8.0' || chr(10) || 'pricing: {{"llm": 0.1}}' || chr(10) ||
  'total_hours: ' || (SELECT printf('%.2f', greatest(0.1e0, round(max(short) * 8e0 / 3600, 2))) FROM sh) || chr(10) || 'behaviour_shares:' || (SELECT string_agg(chr(10) || '  ' || behaviour || ': ' || printf('%.4f', share), '' ORDER BY behaviour) FROM x)
  || chr(10) || 'db_path: "data/runs_topup.db"' || chr(10) || 'corpus_tag: "topup"' || chr(10) AS config WHERE EXISTS (SELECT 1 FROM sh)""")
def audit_topup_config(spark, d):
    """The config that generates what flags lack."""
    short = A.deficits(A.coverage(adapted(spark, d, FRAMES)), 200)
    return D.topup_config(short, A.behaviour_shares(short), 200, {"avg_window_seconds": 8.0, "pricing": {"llm": 0.1}})


SIDECARS = f"""SELECT scenario_id, CASE WHEN turn % 4 = 3 THEN 0e0 ELSE length(user_text) / 16e0 END AS duration_s, turn, user_text FROM ({SCENARIOS}) WHERE turn % 3 <> 1"""


def _sidecars(spark, d):
    """Sidecars as files, by the scenario's name; every eleventh conversation's are broken."""
    path = shared_path(spark, "sidecars")
    word = F.struct(F.col("user_text").alias("text"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s"))
    rows = adapted(spark, d, SIDECARS).withColumn("words", F.when(F.col("turn") % 5 == 0, F.array(word).cast("array<struct<text:string,start_s:double,end_s:double>>")).otherwise(F.array()))
    text = F.when(F.split_part("scenario_id", F.lit("_"), F.lit(1)).cast("long") % 11 == 5, F.lit('{"duration_s": ')).otherwise(F.to_json(F.struct("duration_s", "words")))
    D.write_named(rows.select(F.concat("scenario_id", F.lit(".words.json")).alias("name"), text.alias("body")), f"{path}/in").write.parquet(f"{path}/report")
    return f"{path}/in"


KEPT = "CAST(split_part(scenario_id, '_', 1) AS BIGINT) % 11 <> 5"


@query(f"""SELECT scenario_id, CASE WHEN {KEPT} THEN duration_s END AS duration_s, CASE WHEN {KEPT} THEN CAST(turn % 5 = 0 AS INT) END AS n_words,
  CASE WHEN {KEPT} AND turn % 5 = 0 THEN user_text END AS first_word FROM ({oracle(SIDECARS)})""")
def sources_sidecars(spark, d):
    """A sidecar a scenario, written by tasks under its name and read by it; a broken one has nulls."""
    read = P.read_sidecars(spark, _sidecars(spark, d))
    return read.select("scenario_id", "duration_s", F.when(F.col("words").isNotNull(), F.size("words")).alias("n_words"), F.get("words", F.lit(0))["text"].alias("first_word"))


@query(f"""WITH s AS ({S}), x AS (SELECT scenario_id, duration_s AS real FROM ({oracle(SIDECARS)}) WHERE {KEPT} AND duration_s > 0),
r AS (SELECT length_band AS band, real, greatest(1, {WORDS.format(x='user_text')}) / 2.2e0 AS guessed FROM s LEFT JOIN x USING (scenario_id))
SELECT coalesce(band, 'total') AS band, count(*) AS n, count(real) AS rendered, round(coalesce(sum(real), 0), 4) AS real_s, round(sum(coalesce(real, guessed)), 4) AS projected_s FROM r GROUP BY ROLLUP (band)""")
def audit_rendered_hours(spark, d):
    """Hours by length: the sidecars' durations, and words where there is none."""
    return A.rendered_hours(adapted(spark, d, SCENARIOS), P.read_sidecars(spark, _sidecars(spark, d)))


WAVS = "SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN embedding[1:3] ELSE embedding END AS samples FROM embeddings"


def _wavs(spark, d, path):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    samples = F.when(F.col("vec_id") % 9 == 4, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    files = vectors.select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("name"), D.wav_bytes(samples, 800).alias("body"))
    D.write_named(files, f"{path}/in").write.parquet(f"{path}/report")


@query(f"""WITH w AS ({WAVS}), q AS (SELECT vec_id, list_transform(samples, lambda x: least(32767, greatest(-32768, round_even(CAST(x AS DOUBLE) * 32768, 0))) / 32768e0) AS x FROM w)
SELECT CAST(vec_id AS VARCHAR) AS id, 800 AS sample_rate, round(len(x) / 800e0, 6) AS duration_s, round(ln(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 1920 + 1e-9) + 1e-6), 5) AS energy FROM q""")
def sources_wavs(spark, d):
    """Sound files put together by expressions, written by name, read and decoded again."""
    path = shared_path(spark, "wavs")
    _wavs(spark, d, path)
    rows = codec.read_wavs(spark, f"{path}/in")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("id"), "sample_rate", F.round("duration_s", 6).alias("duration_s"), F.round(F.get("energy", F.lit(0)), 5).alias("energy"))


@query(f"""WITH w AS (SELECT vec_id AS id, 44 + 2 * len(samples) AS bytes FROM ({WAVS})), s AS (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 1 THEN 0e0 ELSE len(embedding) / 800e0 END AS duration_s, CAST(vec_id % 7 <> 2 AS INT) AS n_words FROM embeddings WHERE vec_id % 5 <> 3
  UNION ALL SELECT -1 - vec_id, len(embedding) / 800e0, 1 FROM embeddings WHERE vec_id % 8 = 0)
SELECT CAST(coalesce(w.id, s.id) AS VARCHAR) AS scenario_id, CAST(bytes AS BIGINT) AS bytes, duration_s, coalesce(n_words, 0) AS n_words, array_to_string(list_filter([
  CASE WHEN bytes IS NULL THEN 'sidecar without sound' END, CASE WHEN bytes < 100 THEN 'too small (' || bytes || ' bytes)' END, CASE WHEN s.id IS NULL THEN 'no sidecar' END,
  CASE WHEN duration_s <= 0 THEN 'no duration' END, CASE WHEN n_words = 0 AND duration_s > 0 THEN 'no words in spite of a duration' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM w FULL JOIN s ON w.id = s.id""")
def sources_inventory(spark, d):
    """Sound files beside their sidecars, with what is wrong with each."""
    path = shared_path(spark, "inventory")
    _wavs(spark, d, path)
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    seconds = F.size("embedding") / 800.0
    own = vectors.where("vec_id % 5 <> 3").select("vec_id", F.when(F.col("vec_id") % 6 == 1, 0.0).otherwise(seconds).alias("duration_s"), (F.col("vec_id") % 7 != 2).alias("said"))
    lone = vectors.where("vec_id % 8 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), seconds.alias("duration_s"), F.lit(True).alias("said"))
    words = F.when(F.col("said"), F.array(F.struct(F.lit("so").alias("text")))).otherwise(F.array())
    cars = own.unionByName(lone).select(F.concat(F.col("vec_id").cast("string"), F.lit(".words.json")).alias("name"), F.to_json(F.struct("duration_s", words.alias("words"))).alias("body"))
    D.write_named(cars, f"{path}/in").write.parquet(f"{path}/cars")
    return moves.inventory_report(spark, f"{path}/in", least_bytes=100).withColumn("reasons", F.array_join("reasons", "; "))


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id")
def codec_chunks(spark, d):
    """What messages carry as base64, put together by conversation."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.base64(F.col("text").cast("binary")).alias("chunk"))
    return D.joined_chunks(turns, "conv_id", "turn", "chunk").select("conv_id", F.md5("data").alias("digest"), F.length("data").cast("long").alias("bytes"))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS scenario_id, max(event_id) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT scenario_id, n, 'lines' AS held FROM l UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), CAST(-1 AS BIGINT), 'fallback' FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT scenario_id FROM l)""")
def sources_keyed_lines(spark, d):
    """The last raw line of each user in files sorted by event; users whose lines are all elsewhere come from the fallback."""
    path = shared_path(spark, "lines")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("scenario_id"), F.col("event_id").alias("n"), "event_type")
    events.where("event_type <> 'error'").drop("event_type").repartitionByRange(4, "n").sortWithinPartitions("n").write.json(path)
    fallback = events.select("scenario_id").distinct().withColumn("line", F.to_json(F.struct("scenario_id", F.lit(-1).alias("n"))))
    n = F.get_json_object("line", "$.n").cast("long")
    return P.read_keyed_lines(spark, path, fallback).select("scenario_id", n.alias("n"), F.when(n >= 0, "lines").otherwise("fallback").alias("held"))


JOBS = f"""SELECT split_part(job_key, '|', 1) AS behaviour, split_part(job_key, '|', 2) AS language, split_part(job_key, '|', 3) AS domain, split_part(job_key, '|', 4) AS gender,
  CAST(count(*) AS INT) AS count, split_part(job_key, '|', 5) = '1' AS force_silence, 'short' AS length_band FROM ({CALLS}) GROUP BY ALL"""


@query(f"""WITH j AS ({oracle(JOBS)}), u AS (SELECT 'plan' AS held, * FROM j UNION ALL SELECT 'parts', * FROM j)
SELECT held, behaviour, language, domain, gender, count, force_silence, length_band FROM u
UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, CAST(sum(count) AS INT), NULL, NULL FROM j""")
def plan_files(spark, d):
    """A plan of the jobs that the calls name, written whole and in parts with its summary, and read back."""
    path = shared_path(spark, "plan")
    P.write_plan(adapted(spark, d, JOBS), path, 5)
    whole = P.read_plan(spark, f"{path}/plan").withColumn("held", F.lit("plan"))
    parts = P.read_plan(spark, f"{path}/parts/part=*").withColumn("held", F.lit("parts"))
    summary = spark.read.schema("jobs long, scenarios long, parts long").json(f"{path}/summary").select(F.lit("summary").alias("held"), F.col("scenarios").cast("int").alias("count"))
    return whole.unionByName(parts).unionByName(summary, allowMissingColumns=True)


@query("SELECT conv_id, turn, text, (conv_id + turn) % 13 = 4 AS broken FROM conversations WHERE (conv_id + turn) % 13 <> 4")
def sources_lenient_lines(spark, d):
    """JSON lines of which some are cut off: those that can be read. Read strictly, they fail (test)."""
    path = shared_path(spark, "lenient")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text", ((F.col("conv_id") + F.col("turn")) % 13 == 4).alias("broken"))
    line = F.to_json(F.struct("conv_id", "turn", "text", "broken"), {"ignoreNullFields": "false"})
    rows.select(F.when(F.col("broken"), F.substring(line, 1, 14)).otherwise(line).alias("value")).write.text(path)
    return ST.read_json_lines(spark, path, rows.drop("broken").schema.simpleString()[7:-1].replace(":", " ") + ", broken boolean")


@query(f"""WITH s AS ({S}), w AS (SELECT {WORDS.format(x='user_text')} AS n FROM s) SELECT count(*) AS n, round(quantile_cont(n, 0.5), 6) AS words_median, round(quantile_cont(n, 0.5) / 2.2e0, 1) AS median_s FROM w""")
def quality_median_seconds(spark, d):
    """About how long the median text takes."""
    checked = adapted(spark, d, SCENARIOS).select("user_text", *[F.lit(True).alias(c) for c in ("schema_ok", "vocab_ok", "script_ok")])
    return Q.median_seconds(Q.corpus_report(checked)).select("n", F.round("words_median", 6).alias("words_median"), "median_s")
