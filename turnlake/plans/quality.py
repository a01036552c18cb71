"""Queries of record quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clipped, half_even, script_ok, word_count
from ..operators import quality as Q
from ..sources.adapters import CALLS, MANIFEST, RENDERS, SCENARIOS, TARGETS, adapted, oracle
from .registry import query

S, T, C, M, R = (oracle(x) for x in (SCENARIOS, TARGETS, CALLS, MANIFEST, RENDERS))
WORDS = r"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> ''))"
LIMIT = "CASE length_band WHEN 'extended' THEN 29 WHEN 'long' THEN 66 ELSE 30 END"
LETTERS = r"len(regexp_extract_all(user_text, '\p{L}'))"
INDIC = {"hi": r"[\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097F}]", "gu": r"[\x{0A85}-\x{0AB9}\x{0ABD}\x{0AD0}\x{0AE0}\x{0AE1}\x{0AF9}]", "en": r"[\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"}
SCRIPT = f"""CASE WHEN trim(user_text) = '' THEN false WHEN {LETTERS} = 0 THEN true
  WHEN language = 'en' THEN len(regexp_extract_all(user_text, '{INDIC["en"]}')) / {LETTERS} >= 0.7
  WHEN starts_with(language, 'hi') THEN len(regexp_extract_all(user_text, '{INDIC["hi"]}')) / {LETTERS} >= CASE WHEN language LIKE '%_native' THEN 0.45 ELSE 0.85 END
  ELSE len(regexp_extract_all(user_text, '{INDIC["gu"]}')) / {LETTERS} >= CASE WHEN language LIKE '%_native' THEN 0.45 ELSE 0.85 END END"""
PROBLEM_LIST = f"""CASE WHEN agent_state = 'NAPPING' THEN 'unknown agent state' END, CASE WHEN prosody = 'sung' THEN 'unknown prosody' END, CASE WHEN trim(user_text) = '' THEN 'empty user text' END,
  CASE WHEN {WORDS.format(x='user_text')} > {LIMIT} THEN 'too many words' END, CASE WHEN NOT event_char BETWEEN 0 AND length(user_text) THEN 'event outside text' END"""
PROBLEMS = f"list_filter([{PROBLEM_LIST}], lambda x: x IS NOT NULL)"
CHECKED = f"""s AS ({S}), t AS ({T}),
e AS (SELECT scenario_id, bool_or(flag IN ('BARGE_HARD', 'BARGE_SOFT')) AS barge, bool_or(regexp_matches(spoken_text, '[<>\\[\\]]')) AS brackets, bool_or(frame_offset < 0 OR regexp_matches(spoken_text, '[<>]')) AS bad FROM t GROUP BY scenario_id),
v AS (SELECT s.scenario_id, behaviour, language, gender, user_text, len({PROBLEMS}) = 0 AND e.scenario_id IS NOT NULL AND NOT coalesce(bad, false) AS schema_ok,
  NOT coalesce(brackets, false) AND NOT (behaviour = 'barge_lookalike' AND coalesce(barge, false)) AS vocab_ok, {SCRIPT} AS script_ok FROM s LEFT JOIN e USING (scenario_id))"""


def _checked(spark, d):
    return Q.verdicts(adapted(spark, d, SCENARIOS), adapted(spark, d, TARGETS))


@query(f"""WITH s AS ({S}), t AS ({T}), e AS (SELECT scenario_id, count(*) AS n FROM t GROUP BY scenario_id)
SELECT scenario_id, array_to_string(list_filter([{PROBLEM_LIST}, CASE WHEN n IS NULL THEN 'empty target timeline' END], lambda x: x IS NOT NULL), '; ') AS problems FROM s LEFT JOIN e USING (scenario_id)""")
def quality_problems(spark, d):
    events = adapted(spark, d, TARGETS).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"))
    return adapted(spark, d, SCENARIOS).join(events, "scenario_id", "left").select("scenario_id", F.array_join(Q.problems("n"), "; ").alias("problems"))


@query(f"WITH {CHECKED} SELECT scenario_id, schema_ok, vocab_ok, script_ok FROM v")
def quality_validate(spark, d):
    return _checked(spark, d).select("scenario_id", "schema_ok", "vocab_ok", "script_ok")


@query(f"""WITH {CHECKED}, w AS (SELECT *, {WORDS.format(x='user_text')} AS words FROM v), l AS (SELECT list_sort(list(words)) AS ws, count(*) AS n FROM w)
SELECT (SELECT count(*) FROM w) AS n, round(avg(CAST(schema_ok AS DOUBLE)), 6) AS schema_ok_rate, round(avg(CAST(vocab_ok AS DOUBLE)), 6) AS vocab_ok_rate,
round(avg(CAST(script_ok AS DOUBLE)), 6) AS script_ok_rate, round(avg(words), 6) AS words_mean, quantile_cont(CAST(words AS DOUBLE), 0.5) AS words_median,
(SELECT ws[CAST(least(n - 1, floor(0.1e0 * n)) AS INT) + 1] FROM l) AS words_p10, (SELECT ws[CAST(least(n - 1, floor(0.9e0 * n)) AS INT) + 1] FROM l) AS words_p90 FROM w""")
def quality_corpus_report(spark, d):
    return Q.corpus_report(_checked(spark, d))


@query(f"""WITH {CHECKED}, r AS (SELECT avg(CAST(schema_ok AS DOUBLE)) >= 0.99 AND avg(CAST(vocab_ok AS DOUBLE)) >= 1 AND avg(CAST(script_ok AS DOUBLE)) >= 0.98 AS good FROM v)
SELECT CASE WHEN good THEN 0 ELSE 1 END AS exit_code FROM r""")
def quality_exit_code(spark, d):
    return Q.passes(Q.corpus_report(_checked(spark, d))).select("exit_code")


@query(f"""WITH s AS ({S}), n AS (SELECT count(*) AS n, count(*) FILTER (gender = 'female') AS f, count(*) FILTER (gender = 'male') AS m FROM s),
x AS (SELECT language, count(*) AS c FROM s GROUP BY language)
SELECT (SELECT bool_and(abs(coalesce(c, 0) / CAST((SELECT n FROM n) AS DOUBLE) - 0.2e0) <= 0.02e0) FROM (VALUES ('hi'), ('en'), ('gu'), ('hi_en_native'), ('gu_en_native')) w(language) LEFT JOIN x USING (language)) AS languages_ok,
abs(f - m) / CAST(n AS DOUBLE) <= 0.04e0 AS genders_ok, round(abs(f - m) / CAST(n AS DOUBLE), 6) AS gender_gap FROM n""")
def quality_balance(spark, d):
    return Q.balance(adapted(spark, d, SCENARIOS), {k: 0.2 for k in ("hi", "en", "gu", "hi_en_native", "gu_en_native")})


INDIC_ROWS = "(VALUES ('hi', 'नमस्ते आप कैसे हैं'), ('hi', 'hello नमस्ते'), ('gu', 'કેમ છો ભાઈ'), ('gu', 'hello there'), ('hi_en_native', 'मेरा account बंद है'), ('en', '12345'), ('en', '  '), ('en', 'été déjà'), ('hi', 'ok'))"


@query(f"WITH s AS (SELECT * FROM {INDIC_ROWS} t(language, user_text) UNION ALL SELECT language, user_text FROM ({S})) SELECT language, user_text, {SCRIPT} AS ok FROM s")
def quality_script(spark, d):
    fixed = spark.sql(f"SELECT * FROM {INDIC_ROWS} AS t(language, user_text)")
    rows = fixed.unionByName(adapted(spark, d, SCENARIOS).select("language", "user_text"))
    return rows.withColumn("ok", script_ok(F.col("user_text"), F.col("language")))


@query(f"WITH t AS ({T}) SELECT scenario_id, ord, CASE WHEN frame_offset < 0 THEN 'negative offset' WHEN regexp_matches(spoken_text, '[<>]') THEN 'markup in spoken text' END AS problem FROM t")
def quality_target_events(spark, d):
    return adapted(spark, d, TARGETS).select("scenario_id", "ord", Q.target_problem().alias("problem"))


@query(f"""WITH t AS ({T}) SELECT scenario_id, CASE WHEN count(*) = 0 THEN '—' ELSE array_to_string(list_slice(list(flag ORDER BY ord), 1, 4), '→') || CASE WHEN count(*) > 4 THEN '…' ELSE '' END END AS chain FROM t GROUP BY scenario_id""")
def quality_flag_chain(spark, d):
    flags = F.transform(F.array_sort(F.collect_list(F.struct("ord", "flag"))), lambda x: x["flag"])
    chains = adapted(spark, d, TARGETS).groupBy("scenario_id").agg(flags.alias("flags"))
    return chains.select("scenario_id", Q.flag_chain(F.col("flags")).alias("chain"))


@query(r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS shown FROM f""")
def quality_clip_text(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", clipped(F.col("text"), 40).alias("shown"))


@query(f"""WITH m AS ({M}) SELECT id, CASE WHEN lower(gender) LIKE 'f%' THEN 'female' WHEN lower(gender) LIKE 'm%' THEN 'male' END AS gender, duration_s FROM m
WHERE duration_s BETWEEN 1.5 AND 20 AND trim(coalesce(transcript, '')) <> ''""")
def quality_usable_clips(spark, d):
    return Q.usable_clips(adapted(spark, d, MANIFEST)).select("id", "gender", "duration_s")


@query(f"""WITH r AS ({R}) SELECT scenario_id, array_to_string(list_filter([CASE WHEN chars * 3 < 200 THEN 'tiny file' END, CASE WHEN status = 'error' THEN 'no metadata' END,
CASE WHEN status <> 'error' AND duration_s <= 0 THEN 'no duration' END, CASE WHEN status <> 'error' AND duration_s > 0 AND id % 9 = 0 THEN 'no words' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM r WHERE chars * 3 < 200 OR status = 'error' OR duration_s <= 0 OR id % 9 = 0""")
def quality_corrupt_clips(spark, d):
    reasons = Q.corruption(F.col("chars") * 3, F.col("status") != "error", F.col("duration_s"), F.col("id") % 9)
    return adapted(spark, d, RENDERS).withColumn("r", reasons).where(F.size("r") > 0).select("scenario_id", F.array_join("r", ", ").alias("reasons"))


@query(f"WITH c AS ({C}) SELECT id, CASE WHEN error IS NOT NULL THEN 'api_error' WHEN returned_n = 0 THEN 'parse_error' WHEN valid_n = 0 THEN 'all_invalid' ELSE 'ok' END AS derived, coalesce(regexp_matches(error, '\\b(502|503|504)\\b'), false) AS transient FROM c")
def quality_batch_status(spark, d):
    calls = adapted(spark, d, CALLS)
    return calls.select("id", Q.batch_status(F.col("returned_n"), F.col("valid_n"), F.col("error")).alias("derived"), Q.transient(F.col("error")).alias("transient"))


@query(f"WITH c AS ({C}) SELECT id, split_part(job_key, '|', 1) AS behaviour, split_part(job_key, '|', 2) AS language, split_part(job_key, '|', 5) AS silent, split_part(job_key, '|', 6) AS band, CAST(regexp_extract('fail' || CAST(id AS VARCHAR) || 'x', '^fail(\\d+)', 1) AS INT) AS nth FROM c")
def quality_job_key_parts(spark, d):
    part = lambda k: F.split_part("job_key", F.lit("|"), F.lit(k))
    flag = F.concat(F.lit("fail"), F.col("id").cast("string"), F.lit("x"))
    return adapted(spark, d, CALLS).select(
        "id", part(1).alias("behaviour"), part(2).alias("language"), part(5).alias("silent"), part(6).alias("band"),
        F.regexp_extract(flag, r"^fail(\d+)", 1).cast("int").alias("nth"))


@query(f"WITH m AS ({M}) SELECT id, CAST(round_even(duration_s * 12.5e0, 0) AS BIGINT) AS frames, round(round_even(duration_s * 12.5e0, 0) / 12.5e0, 6) AS seconds FROM m")
def quality_frame_time(spark, d):
    frames = half_even(F.col("duration_s") * 12.5)
    return adapted(spark, d, MANIFEST).select("id", frames.alias("frames"), F.round(frames / 12.5, 6).alias("seconds"))


@query(f"""WITH s AS ({S}), t AS ({T}), x AS (SELECT scenario_id, string_agg(trim(spoken_text), ' ' ORDER BY ord) FILTER (trim(spoken_text) <> '') AS said FROM t GROUP BY scenario_id)
SELECT scenario_id, '<|sys|> Decide who speaks.<|agent|> ' || coalesce(agent_text, '') || '<|stt|> ' || coalesce(user_text, '') AS context, CASE WHEN said IS NULL THEN '' ELSE '<|say|> ' || said || ' <|/say|>' END AS tail,
CASE WHEN trim(coalesce(user_text, '')) = '' THEN '' ELSE '<|say|> ' || user_text || ' <|/say|>' END AS first_tail FROM s LEFT JOIN x USING (scenario_id)""")
def quality_training_text(spark, d):
    spoken = F.transform(F.array_sort(F.collect_list(F.struct("ord", "spoken_text"))), lambda x: F.trim(x["spoken_text"]))
    said = adapted(spark, d, TARGETS).groupBy("scenario_id").agg(spoken.alias("said"))
    rows = adapted(spark, d, SCENARIOS).join(said, "scenario_id", "left")
    user = F.col("user_text")
    return rows.select(
        "scenario_id", Q.training_context("Decide who speaks.", F.col("agent_text"), user).alias("context"), Q.spoken_tail(user, F.col("said")).alias("tail"),
        Q.spoken_tail(user, F.col("said"), phase=1).alias("first_tail"))


@query("SELECT event_id, CAST(json_extract_string(regexp_extract('noise ' || props || ' end', '(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events")
def quality_json_in_prose(spark, d):
    prose = F.concat(F.lit("noise "), F.col("props"), F.lit(" end"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object(Q.json_in_prose(prose), "$.k").cast("long").alias("k"))
