"""The domain's tables over the driver's tables; each text serves Spark and the oracle alike.

Names in braces stand for tables and for what the dialects call differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocab import BEHAVIOURS, DOMAINS, GENDERS, LANGUAGES, PROSODIES

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations embeddings".split()


def _pick(names: list[str], at: str) -> str:
    return f"split_part('{','.join(names)}', ',', CAST({at} AS INT))"


KEY = " || '|' || ".join([
    _pick(BEHAVIOURS, "user_id % 12 + 1"), _pick(LANGUAGES, "user_id % 5 + 1"), _pick(DOMAINS, "user_id % 3 + 1"), _pick(GENDERS, "user_id % 2 + 1"),
    "CAST(user_id % 2 AS STRING)",
])

#: Calls of a language model: one row a call.
CALLS = f"""SELECT event_id AS id, 'run' || CAST(event_id % 5 AS STRING) AS run_id, {KEY} AS job_key,
  CASE event_type WHEN 'error' THEN 'api_error' WHEN 'signup' THEN 'all_invalid' WHEN 'purchase' THEN NULL ELSE 'ok' END AS status,
  CAST(12 AS BIGINT) AS requested_n, CASE WHEN event_type = 'error' THEN 0 ELSE 1 + event_id % 12 END AS returned_n,
  CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE event_id % 12 END AS valid_n,
  100 + event_id % 57 AS prompt_tokens, 400 + event_id % 91 AS completion_tokens,
  abs(value) * 10e0 AS latency_ms, CASE WHEN event_type = 'error' THEN 'status ' || CAST(500 + event_id % 7 AS STRING) || ' from server' END AS error,
  {{epoch}} / 1e6 AS created_at FROM {{events}}"""

#: Renderings of speech: one row a clip.
RENDERS = """SELECT event_id AS id, 'run' || CAST(event_id % 5 AS STRING) AS run_id, 'sc' || CAST(event_id AS STRING) AS scenario_id,
  40 + event_id % 200 AS chars, CAST(event_id % 30 AS DOUBLE) AS duration_s,
  CASE WHEN event_type = 'error' THEN 'rate_limited' WHEN event_type = 'signup' THEN 'error' ELSE 'ok' END AS status,
  abs(value) * 5e0 AS latency_ms, {epoch} / 1e6 AS created_at FROM {events}"""

#: Dense frames of a clip with a flag id each, and a prediction that is wrong at every seventh event.
FRAMES = """SELECT clip, frame, flag, CASE WHEN event_id % 7 = 0 THEN coalesce(lag(flag) OVER (PARTITION BY clip ORDER BY frame), 0) ELSE flag END AS pred,
  event_id % 11 <> 0 AS valid, value, event_id FROM (
  SELECT user_id AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 5 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 7 ELSE 2 END AS flag, event_id, value
  FROM {events})"""

#: Clips of a speech corpus.
MANIFEST = """SELECT CAST(doc_id AS STRING) AS id, lang, source, text AS transcript, CASE doc_id % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'male' WHEN 2 THEN 'm' ELSE NULL END AS gender,
  n_chars / 100e0 AS duration_s, doc_id FROM {documents}"""

#: Dialogue windows: a user's turn after an agent's.
SCENARIOS = f"""SELECT CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS scenario_id, conv_id, turn,
  {_pick(BEHAVIOURS, "(conv_id + turn) % 12 + 1")} AS behaviour, {_pick(LANGUAGES, "conv_id % 5 + 1")} AS language,
  {_pick(DOMAINS, "conv_id % 3 + 1")} AS domain, {_pick(GENDERS, "conv_id % 2 + 1")} AS gender,
  {_pick(["short", "extended", "long", "odd"], "turn % 4 + 1")} AS length_band,
  {_pick(["IDLE", "LLM_GEN", "TTS_SPEAKING", "TTS_DONE", "NAPPING"], "(conv_id + turn) % 5 + 1")} AS agent_state,
  {_pick([*PROSODIES, "sung"], "(conv_id * 3 + turn) % 7 + 1")} AS prosody,
  coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS agent_text, text AS user_text,
  CAST(turn * 9 AS INT) AS event_char FROM {{conversations}}"""

#: Up to three events of each scenario, in list order: some timelines are empty, some offsets negative, some speech blank or in brackets.
TARGETS = f"""SELECT scenario_id, CAST(k AS INT) AS ord, CAST(CASE WHEN turn % 3 = 2 AND k = 2 THEN 1 ELSE k * 5 + length(user_text) % 7 - CASE WHEN turn % 7 = 3 THEN 6 ELSE 0 END END AS INT) AS frame_offset,
  {_pick(["LISTEN", "HOLD", "INCOMPLETE", "TURN_END", "BARGE_SOFT", "BARGE_HARD", "CONTINUE", "PREFETCH_LLM", "COMMIT_LLM", "CANCEL_LLM", "SILENCE_BREAK"], "(length(user_text) + k * turn) % 11 + 1")} AS flag,
  CASE WHEN k = 1 THEN split_part(' ok |ok|[hm]| ', '|', CAST(length(user_text) % 4 + 1 AS INT)) ELSE '' END AS spoken_text
  FROM ({SCENARIOS}) s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) e WHERE (conv_id + turn) % 9 <> 4"""

#: The energy of every other turn's audio, a frame a row.
HEARD = f"""SELECT scenario_id, CAST(i AS INT) AS frame, CAST(v AS DOUBLE) * 10e0 AS e FROM ({SCENARIOS}) s JOIN (SELECT vec_id, {{unnested}} FROM {{embeddings}}) x ON vec_id = conv_id WHERE turn % 2 = 1"""

def adapted(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of an adapter on Spark."""
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{epoch}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{unnested}", "posexplode(embedding) AS (i, v)"), **found)


def oracle(text: str) -> str:
    """An adapter's text for the oracle."""
    return text.format(epoch="epoch_us(ts)", unnested="generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v", **{t: t for t in TABLES})
