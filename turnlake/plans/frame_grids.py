"""Queries of the frame family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import FLAGS, PAINT_ORDER, PRIMARY, WIDTHS
from ..operators import frames as G
from ..operators import vad as V
from ..sources.adapters import FRAMES, HEARD, SCENARIOS, TARGETS, adapted, oracle
from .quality import WORDS
from .registry import query

S, T, FR = oracle(SCENARIOS), oracle(TARGETS), oracle(FRAMES)
FLAG_IDS = "list_position([" + ", ".join(f"'{f}'" for f in FLAGS) + "], {x}) - 1"
#: Characters of a clip's speech take 0.06 s each; two clips of three have such timings.
SPANS = r"""s AS (@S), t AS (@T), w AS (SELECT scenario_id, event_char, trim(regexp_replace(user_text, '\s+', ' ', 'g')) AS txt FROM s WHERE conv_id % 3 <> 0),
x AS (SELECT scenario_id, event_char, unnest(string_split(txt, ' ')) AS word, generate_subscripts(string_split(txt, ' '), 1) - 1 AS i FROM w),
y AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY scenario_id ORDER BY i) - length(word) - 1 AS start_char FROM x),
sp AS (SELECT scenario_id, event_char, i, word, start_char, start_char + length(word) - 1 AS end_char, start_char * 0.06e0 AS start_s, (start_char + length(word)) * 0.06e0 AS end_s FROM y WHERE word <> ''),
tm AS (SELECT scenario_id, coalesce(min(CASE WHEN event_char BETWEEN start_char AND end_char THEN start_s + (end_s - start_s) * (event_char - start_char) / greatest(1, end_char - start_char) END),
  max(end_s)) AS seconds, max(end_s) AS duration_s FROM sp GROUP BY scenario_id)""".replace("@S", S).replace("@T", T)
PRIMARIES = "CASE behaviour " + " ".join(f"WHEN '{b}' THEN '{f}'" for b, f in PRIMARY.items()) + " END"
EVENTS = f"""{SPANS},
o AS (SELECT scenario_id, coalesce(arg_min(frame_offset, ord) FILTER (flag = {PRIMARIES}), arg_max(frame_offset, ord)) AS base FROM t JOIN s USING (scenario_id) GROUP BY scenario_id),
ev AS (SELECT t.scenario_id, ord, flag, spoken_text, CASE WHEN seconds IS NULL THEN frame_offset ELSE greatest(0, frame_offset + CAST(round_even(seconds * 12.5e0, 0) AS BIGINT) - base) END AS fr
  FROM t JOIN o USING (scenario_id) LEFT JOIN tm USING (scenario_id)
  UNION ALL SELECT scenario_id, -1, 'LISTEN', '', 0 FROM s WHERE scenario_id NOT IN (SELECT scenario_id FROM t))"""
CLIPS = f"""{EVENTS}, h AS ({oracle(HEARD)}), hn AS (SELECT scenario_id, count(*) AS encoded FROM h GROUP BY scenario_id), e AS (SELECT scenario_id, max(fr) AS last FROM ev GROUP BY scenario_id),
sized AS (SELECT s.*, last, coalesce(encoded, CAST(round_even(duration_s * 12.5e0, 0) AS BIGINT), CAST(round_even(greatest(1, {WORDS.format(x='user_text')}) / 2.2e0 * 12.5e0, 0) AS BIGINT)) AS audio_frames
  FROM s JOIN e USING (scenario_id) LEFT JOIN hn USING (scenario_id) LEFT JOIN tm USING (scenario_id)),
c AS (SELECT *, greatest(16, audio_frames, last + 1) + 8 AS num_frames FROM sized),
g AS (SELECT scenario_id, CAST(unnest(range(0, num_frames)) AS INT) AS frame FROM c)"""
GRID = f"""{CLIPS}, n AS (SELECT *, row_number() OVER l AS k, lead(fr) OVER l AS nxt FROM ev WINDOW l AS (PARTITION BY scenario_id ORDER BY fr, ord)),
r AS (SELECT scenario_id, k, flag, unnest(range(greatest(0, fr), CASE WHEN flag IN ('LISTEN', 'HOLD', 'INCOMPLETE', 'CONTINUE') THEN coalesce(nxt, 100000) ELSE greatest(0, fr) + 1 END)) AS frame FROM n),
p AS (SELECT scenario_id, frame, max_by(flag, k) AS flag FROM r GROUP BY ALL),
f AS (SELECT g.scenario_id, g.frame, coalesce(p.flag, CASE WHEN c.agent_state IN ('TTS_SPEAKING', 'LLM_GEN') THEN 'HOLD' ELSE 'LISTEN' END) AS flag, c.agent_state FROM g JOIN c USING (scenario_id) LEFT JOIN p USING (scenario_id, frame)),
gr AS (SELECT scenario_id, frame, CAST({FLAG_IDS.format(x='flag')} AS INT) AS flag, CAST(coalesce(last_value(CASE WHEN flag IN ('BARGE_HARD', 'CANCEL_LLM') THEN 0 WHEN flag IN ('TURN_END', 'COMMIT_LLM', 'PREFETCH_LLM') THEN 1
  WHEN flag IN ('SILENCE_BREAK', 'BARGE_SOFT') THEN 2 END IGNORE NULLS) OVER (PARTITION BY scenario_id ORDER BY frame), list_position(['IDLE', 'LLM_GEN', 'TTS_SPEAKING', 'TTS_DONE'], agent_state) - 1, 0) AS INT) AS state FROM f)"""


def _spans(clips):
    """Words of two clips of three, from characters of 0.06 s each."""
    flat = F.trim(F.regexp_replace("user_text", r"(?U)\s+", " "))
    letters = F.transform(F.filter(F.split(flat, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), (i * 0.06).alias("start_s"), ((i + 1) * 0.06).alias("end_s")))
    return clips.where("conv_id % 3 <> 0").withColumn("letters", letters).withColumn("words", G.words_of_characters(F.col("letters"))).drop("letters")


def _timed(spark, d):
    """(scenario_id, seconds, duration_s) of the clips with words: their event's time and their length."""
    words = _spans(adapted(spark, d, SCENARIOS)).select("scenario_id", "event_char", "words")
    return words.select("scenario_id", G.char_to_time(F.col("words"), F.col("event_char")).alias("seconds"), F.try_element_at("words", F.lit(-1))["end_s"].alias("duration_s"))


def _moved(spark, d):
    clips = G.with_events(adapted(spark, d, SCENARIOS), adapted(spark, d, TARGETS)).join(_timed(spark, d), "scenario_id", "left")
    return G.calibrated(clips, G.seconds_to_frames(F.col("seconds")), G.primary_flag(F.col("behaviour")))


def _heard(spark, d):
    return adapted(spark, d, HEARD)


def _clips(spark, d):
    encoded = _heard(spark, d).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("encoded_frames"))
    return G.lengths(_moved(spark, d).join(encoded, "scenario_id", "left"))


@query(f"WITH {CLIPS} SELECT scenario_id, audio_frames, CAST(num_frames AS BIGINT) AS num_frames FROM c")
def frames_lengths(spark, d):
    return _clips(spark, d).select("scenario_id", "audio_frames", "num_frames")


@query(f"WITH {GRID} SELECT scenario_id, frame, flag, state FROM gr")
def frames_grid(spark, d):
    return G.long_grid(_clips(spark, d))


@query(f"WITH {SPANS} SELECT scenario_id, round(seconds, 6) AS seconds FROM tm")
def frames_char_to_time(spark, d):
    return _timed(spark, d).select("scenario_id", F.round("seconds", 6).alias("seconds"))


@query(f"WITH {EVENTS} SELECT scenario_id, ord, CAST(fr AS INT) AS frame FROM ev")
def frames_calibrate(spark, d):
    return _moved(spark, d).select("scenario_id", F.explode("events").alias("e")).select("scenario_id", "e.ord", F.col("e.frame_offset").alias("frame"))


ENERGY = "SELECT vec_id AS clip, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS frame, CAST(unnest(embedding) AS DOUBLE) * 10 AS e FROM embeddings"
TRACK = f"""en AS ({ENERGY}), cl AS (SELECT clip, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.95) AS hi FROM en GROUP BY clip),
tr AS (SELECT en.clip, frame, CASE WHEN hi - lo < 1 THEN 1 ELSE coalesce(last_value(CASE WHEN e > lo + 0.45e0 * (hi - lo) THEN 1 WHEN e <= lo + 0.3e0 * (hi - lo) THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY en.clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS speaking FROM en JOIN cl USING (clip))"""


def _flip(source: str, name: str, of: int, least: int) -> str:
    return f"""{name}a AS (SELECT *, coalesce(CAST(speaking <> lag(speaking) OVER (PARTITION BY clip ORDER BY frame) AS INT), 0) AS ch FROM {source}),
{name}b AS (SELECT *, sum(ch) OVER (PARTITION BY clip ORDER BY frame) AS isl FROM {name}a),
{name} AS (SELECT clip, frame, CASE WHEN speaking = {of} AND count(*) OVER (PARTITION BY clip, isl) < {least} THEN {1 - of} ELSE speaking END AS speaking FROM {name}b)"""


SMOOTH = f"{TRACK}, {_flip('tr', 'f1', 0, 3)}, {_flip('f1', 'f2', 1, 2)}"


def _energy(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("frame", "x")).select(
        "clip", "frame", (F.col("x").cast("double") * 10).alias("e"))


@query(f"WITH {TRACK} SELECT clip, frame, speaking FROM tr")
def vad_hysteresis(spark, d):
    return V.hysteresis(_energy(spark, d)).select("clip", "frame", "speaking")


@query(f"WITH {SMOOTH} SELECT clip, frame, speaking FROM f2")
def vad_fill_runs(spark, d):
    return V.smoothed(V.hysteresis(_energy(spark, d))).select("clip", "frame", "speaking")


@query(f"""WITH {SMOOTH}, a AS (SELECT clip, frame, list(speaking) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS l FROM f2)
SELECT clip, frame, array_to_string(list_slice(list_concat(coalesce(l, []), list_transform(range(25), lambda x: 0)), 1, 25), '') AS ahead FROM a""")
def frames_lookahead(spark, d):
    track = V.smoothed(V.hysteresis(_energy(spark, d)))
    return G.lookahead(track, "clip", "frame", "speaking").select("clip", "frame", F.array_join(F.col("ahead").cast("array<string>"), "").alias("ahead"))


def _wide(flag: str) -> str:
    out = flag
    for name in reversed(PAINT_ORDER):
        b, a = WIDTHS[name]
        i = FLAGS.index(name)
        out = f"CASE WHEN max(CASE WHEN flag = {i} THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) = 1 THEN {i} ELSE {out} END"
    return out


@query(f"WITH f AS ({FR}) SELECT clip, frame, {_wide('flag')} AS widened FROM f")
def frames_expand_events(spark, d):
    return G.widened(adapted(spark, d, FRAMES), "clip", "frame", "flag").select("clip", "frame", "widened")


@query(f"WITH f AS ({FR}) SELECT clip, frame, coalesce(last_value(CASE WHEN flag IN (3, 5) THEN flag END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried FROM f")
def frames_fill_forward(spark, d):
    rows = adapted(spark, d, FRAMES).withColumn("mark", F.when(F.col("flag").isin(3, 5), F.col("flag")))
    return G.filled_forward(rows, "clip", "frame", "mark").select("clip", "frame", F.coalesce("carried", F.lit(-1)).alias("carried"))


@query("SELECT vec_id, round(list_sum(list_transform(list_slice(list_concat(embedding, list_transform(range(80), lambda x: CAST(-1 AS FLOAT))), 1, 70), lambda x: CAST(x AS DOUBLE))), 4) AS total, 70 AS n FROM embeddings")
def frames_pad_trim(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    fit = G.fitted(F.col("embedding"), F.lit(70), F.lit(-1.0).cast("float"))
    total = F.aggregate(fit, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return vectors.select("vec_id", F.round(total, 4).alias("total"), F.size(fit).alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x * 500 > 1 THEN ln(CAST(x AS DOUBLE) * 500) - ln(150) ELSE 0 END)), 4) AS pitch FROM embeddings")
def frames_log_pitch(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 500)
    total = F.aggregate(G.log_pitch(scaled), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(total, 4).alias("pitch"))


@query("""WITH p AS (SELECT vec_id, embedding, unnest(range(0, 20)) AS k FROM embeddings), q AS (SELECT *, k * (len(embedding) - 1) / 19e0 AS x FROM p)
SELECT vec_id, CAST(k AS INT) AS k, round(CAST(embedding[CAST(floor(x) AS INT) + 1] AS DOUBLE) + (CAST(embedding[least(CAST(floor(x) AS INT) + 2, len(embedding))] AS DOUBLE) - CAST(embedding[CAST(floor(x) AS INT) + 1] AS DOUBLE)) * (x - floor(x)), 5) AS value FROM q""")
def frames_resize(spark, d):
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(G.resized(values, 20)).alias("k", "v"))
    return rows.select("vec_id", "k", F.round("v", 5).alias("value"))


@query(f"""WITH f AS ({FR}), b AS (SELECT clip, frame // 16 AS frame, sum(value * value) / 16 AS p FROM f GROUP BY ALL)
SELECT clip, CAST(frame AS INT) AS frame, round(ln(sqrt(p + 1e-9) + 1e-6), 5) AS energy FROM b""")
def vad_frame_energy(spark, d):
    rows = V.frame_energy(adapted(spark, d, FRAMES), "clip", "frame", "value", 16)
    return rows.select("clip", "frame", F.round("energy", 5).alias("energy"))


@query(f"WITH {SPANS} SELECT scenario_id, string_agg(word || ':' || start_char || '-' || end_char, ' ' ORDER BY i) AS words, round(sum(end_s - start_s), 6) AS spoken_s FROM sp GROUP BY scenario_id")
def frames_word_spans(spark, d):
    rows = _spans(adapted(spark, d, SCENARIOS))
    text = F.array_join(F.transform("words", lambda w: F.concat(w["text"], F.lit(":"), w["start_char"].cast("string"), F.lit("-"), w["end_char"].cast("string"))), " ")
    spoken = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["end_s"] - w["start_s"])
    return rows.select("scenario_id", text.alias("words"), F.round(spoken, 6).alias("spoken_s"))


HEARD_TRACK = f"{TRACK}, {_flip('tr', 'f1', 0, 3)}, {_flip('f1', 'f2', 1, 2)}".replace(ENERGY, "SELECT scenario_id AS clip, frame, e FROM h")
MARKS = f"""{GRID}, {HEARD_TRACK}, sn AS (SELECT scenario_id, greatest(0, fr) AS frame, ord, trim(spoken_text) AS txt FROM ev WHERE trim(spoken_text) <> ''),
m AS (SELECT gr.*, audio_frames, num_frames, EXISTS (SELECT 1 FROM sn WHERE sn.scenario_id = gr.scenario_id AND sn.frame = gr.frame) AS said,
  CASE WHEN gr.scenario_id IN (SELECT clip FROM f2) THEN coalesce(f2.speaking, 0) ELSE CAST(gr.frame < audio_frames AS INT) END AS vad
  FROM gr JOIN c USING (scenario_id) LEFT JOIN f2 ON f2.clip = gr.scenario_id AND f2.frame = gr.frame)"""


@query(f"""WITH {MARKS} SELECT scenario_id, CAST(any_value(num_frames) AS INT) AS num_frames, CAST(any_value(audio_frames) AS INT) AS audio_frames, string_agg(flag, ' ' ORDER BY frame) AS flags, string_agg(state, '' ORDER BY frame) AS agent_state,
string_agg(CAST(said AS INT), '' ORDER BY frame) AS speaking_mask, string_agg(vad, '' ORDER BY frame) AS vad,
coalesce((SELECT string_agg(frame || ':' || txt, ';' ORDER BY frame, ord) FROM sn WHERE sn.scenario_id = m.scenario_id), '') AS spoken FROM m GROUP BY scenario_id""")
def frames_records(spark, d):
    """Whole training records, their arrays as text."""
    rows = G.frame_records(_clips(spark, d), _heard(spark, d))
    text = lambda c, by="": F.array_join(F.col(c).cast("array<string>"), by).alias(c)
    spoken = F.array_join(F.transform("spoken_spans", lambda s: F.concat(s["frame"].cast("string"), F.lit(":"), s["text"])), ";")
    return rows.select("scenario_id", "num_frames", "audio_frames", text("flags", " "), text("agent_state"), text("speaking_mask"), text("vad"), spoken.alias("spoken"))


@query(f"""WITH {MARKS}, a AS (SELECT scenario_id, frame, coalesce(sum(vad) OVER (PARTITION BY scenario_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING), 0) AS n FROM m)
SELECT scenario_id, frame, CAST(n AS BIGINT) AS speaking_ahead FROM a""")
def frames_vap_targets(spark, d):
    """How many of the next 25 frames are speech: the sums of the targets' rows."""
    rows = G.frame_records(_clips(spark, d), _heard(spark, d)).select("scenario_id", F.posexplode(G.vap_targets(F.col("vad"))).alias("frame", "ahead"))
    return rows.select("scenario_id", "frame", F.aggregate("ahead", F.lit(0), lambda a, x: a + x).cast("long").alias("speaking_ahead"))


@query(f"""WITH {MARKS} SELECT scenario_id, CASE WHEN any_value(conv) % 3 = 0 THEN string_agg(said, '' ORDER BY frame) WHEN scenario_id IN (SELECT clip FROM f2) THEN string_agg(vad, '' ORDER BY frame)
ELSE repeat('1', CAST(any_value(num_frames) AS INT)) END AS track FROM (SELECT m.* REPLACE (CAST(said AS INT) AS said), conv_id AS conv FROM m JOIN s USING (scenario_id)) GROUP BY scenario_id""")
def frames_track_source(spark, d):
    """Of a record's own track, the one heard in its energy and none at all, the first there is."""
    clips, heard = _clips(spark, d), _heard(spark, d)
    records = G.frame_records(clips, heard).join(clips.select("scenario_id", "conv_id", "encoded_frames"), "scenario_id")
    own = F.when(F.col("conv_id") % 3 == 0, F.col("speaking_mask"))
    track = G.track_of(own, F.when(F.col("encoded_frames") > 0, F.col("vad")), F.col("num_frames"))
    return records.select("scenario_id", F.array_join(track.cast("array<string>"), "").alias("track"))
