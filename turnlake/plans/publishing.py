"""Queries of publishing, monitoring and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import publishing as P
from ..sources.adapters import CALLS, FRAMES, MANIFEST, RENDERS, SCENARIOS, adapted, oracle
from .registry import query

C, FR, M, R, S = (oracle(x) for x in (CALLS, FRAMES, MANIFEST, RENDERS, SCENARIOS))
#: A clip's state of work, from its number.
WORK = "SELECT *, id % 7 <> 0 AS has_wav, id % 5 <> 0 AS has_meta, CASE WHEN id % 11 = 0 THEN '  ' ELSE status END AS user_text FROM ({renders})"


def _clips(spark, d):
    renders = adapted(spark, d, RENDERS)
    text = F.when(F.col("id") % 11 == 0, "  ").otherwise(F.col("status"))
    return renders.withColumns({"has_wav": F.col("id") % 7 != 0, "has_meta": F.col("id") % 5 != 0, "user_text": text})


@query(f"WITH w AS ({WORK.format(renders=R)}) SELECT scenario_id FROM w WHERE has_wav AND has_meta AND duration_s > 0 AND trim(user_text) <> '' AND id % 3 <> 0")
def publish_pending(spark, d):
    clips = _clips(spark, d)
    return P.publishable(clips, clips.where("id % 3 = 0").select("scenario_id")).select("scenario_id")


@query("SELECT doc_id AS scenario_id, quality, CAST(e.vec_id IS NOT NULL AS INT) AS timed FROM documents JOIN labels USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = doc_id")
def publish_matched(spark, d):
    docs, labels, vectors = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "embeddings"))
    key = lambda df, c: df.withColumnRenamed(c, "scenario_id")
    rows = P.matched(key(docs, "doc_id").select("scenario_id"), key(labels, "doc_id"), key(vectors, "vec_id").select("scenario_id"))
    return rows.select("scenario_id", "quality", F.col("has_timestamps").cast("int").alias("timed"))


@query("SELECT count(*) AS wavs, count(*) FILTER (l.doc_id IS NULL) AS no_scenario, count(*) FILTER (l.doc_id IS NOT NULL AND e.vec_id IS NULL) AS no_timestamps FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def publish_misses(spark, d):
    docs, labels, vectors = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "embeddings"))
    ids = [df.select(F.col(c).alias("scenario_id")) for df, c in ((docs, "doc_id"), (labels, "doc_id"), (vectors, "vec_id"))]
    return P.misses(*ids)


def _encoded(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 6 == 0, 0).otherwise(F.size("embedding")).alias("frames"))


ENC = "n AS (SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 6 = 0 THEN 0 ELSE len(embedding) END AS frames FROM embeddings)"


@query(f"WITH m AS ({M}), {ENC} SELECT id, duration_s, CAST(frames AS INT) AS frames FROM m JOIN n USING (id) WHERE frames > 0")
def publish_encoded(spark, d):
    return P.encoded_manifest(adapted(spark, d, MANIFEST), _encoded(spark, d)).select("id", "duration_s", "frames")


@query(f"WITH m AS ({M}), {ENC} SELECT count(*) AS clips, count(*) FILTER (frames IS NULL) AS missing, count(*) FILTER (frames <= 0) AS empty FROM m LEFT JOIN n USING (id)")
def publish_encoded_counts(spark, d):
    return P.encoded_counts(adapted(spark, d, MANIFEST), _encoded(spark, d))


@query(f"WITH m AS ({M}), {ENC} SELECT id FROM m WHERE id IN (SELECT id FROM n WHERE frames > 0)")
def storage_deletable(spark, d):
    return P.deletable(adapted(spark, d, MANIFEST).select("id"), _encoded(spark, d))


@query(f"WITH r AS ({R}) SELECT id FROM r WHERE NOT (run_id = 'run1' AND status IS NOT DISTINCT FROM 'ok')")
def storage_scoped_delete(spark, d):
    return P.without_scope(adapted(spark, d, RENDERS), run_id="run1", status="ok").select("id")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path FROM pages")
def publish_portable_paths(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", P.portable_path(F.col("url"), "https://").alias("path"))


@query(f"""WITH r AS ({R}) SELECT id, CASE WHEN id % 4 = 0 THEN 'skipped' WHEN status = 'rate_limited' THEN 'rate_limited' WHEN status = 'error' THEN 'error' WHEN duration_s <= 0 THEN 'error' ELSE 'ok' END AS outcome FROM r""")
def publish_render_status(spark, d):
    error = F.when(F.col("status") == "rate_limited", "HTTP 429 from server").when(F.col("status") == "error", "broken pipe")
    return adapted(spark, d, RENDERS).select("id", P.render_status(F.col("id") % 4 == 0, error, F.col("duration_s")).alias("outcome"))


VOICES = "v AS (SELECT doc_id AS place, list_extract(['f_', 'M_', 'female_', 'x_'], CAST(doc_id % 4 + 1 AS INT)) || 'voice' || CAST(doc_id AS VARCHAR) || '.wav' AS file, lang FROM documents)"
GENDER = "CASE WHEN lower(file) SIMILAR TO '(female|f)_.*' THEN 'female' WHEN lower(file) SIMILAR TO '(male|m)_.*' THEN 'male' END"


def _voices(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("f_", "M_", "female_", "x_"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("place"), F.concat(head, F.lit("voice"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"), "lang")
    gender, name = P.voice_parts(F.col("file"))
    return rows.withColumns({"gender": gender, "voice": name})


@query(f"WITH {VOICES} SELECT file, {GENDER} AS gender, CASE WHEN {GENDER} IS NOT NULL THEN regexp_extract(file, '_(.*)[.]wav', 1) END AS voice FROM v")
def voices_parsed(spark, d):
    return _voices(spark, d).select("file", "gender", "voice")


@query(f"WITH {VOICES} SELECT {GENDER} AS gender, count(*) FILTER (lang = 'en') AS cloned, count(*) FILTER (lang = 'de') AS standard FROM v GROUP BY 1")
def voices_totals(spark, d):
    return P.voice_totals(_voices(spark, d).withColumn("source", F.when(F.col("lang") == "en", "cloned").when(F.col("lang") == "de", "standard")))


@query(f"WITH {VOICES}, g AS (SELECT {GENDER} AS gender, list(regexp_extract(file, '_(.*)[.]wav', 1) ORDER BY place) AS l FROM v WHERE place < 40 GROUP BY 1) SELECT gender, array_to_string(l, ' ') AS voices FROM g WHERE gender IS NOT NULL")
def voices_by_gender(spark, d):
    """The first forty recordings are the catalogue."""
    rows = P.voices_by_gender(_voices(spark, d).where("place < 40 AND gender IS NOT NULL"))
    return rows.select("gender", F.array_join("voices", " ").alias("voices"))


@query(f"""WITH {VOICES}, g AS (SELECT {GENDER} AS gender, list(regexp_extract(file, '_(.*)[.]wav', 1) ORDER BY place) AS l FROM v WHERE place < 40 GROUP BY 1), s AS ({S})
SELECT scenario_id, l[CAST((CAST(CAST('0x' || substr(md5(user_text), 1, 16) AS UBIGINT) AS HUGEINT) % len(l) * (18446744073709551616::HUGEINT % len(l)) + CAST(CAST('0x' || substr(md5(user_text), 17, 16) AS UBIGINT) AS HUGEINT) % len(l)) % len(l) AS INT) + 1] AS voice FROM s LEFT JOIN g USING (gender)""")
def voices_rotation(spark, d):
    """A voice of the scenario's gender by the hash of its text."""
    voices = _voices(spark, d).where("place < 40 AND gender IS NOT NULL")
    return P.voice_of(adapted(spark, d, SCENARIOS), voices, F.col("user_text")).select("scenario_id", "voice")


@query(f"""WITH {VOICES}, w AS (SELECT md5(file) AS hash, {GENDER} AS gender, file AS name, place FROM v WHERE {GENDER} IS NOT NULL), n AS (SELECT * FROM w WHERE place % 5 <> 0),
b AS (SELECT greatest(0, 400 - (SELECT count(*) FROM w WHERE place % 5 = 0)) AS budget), g AS (SELECT gender, count(*) AS weight FROM n GROUP BY gender),
x AS (SELECT *, weight * least(budget, sum(weight) OVER ()) / CAST(sum(weight) OVER () AS DOUBLE) AS e, least(budget, sum(weight) OVER ()) AS total FROM g, b),
q AS (SELECT gender, floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, gender) <= total - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM x),
k AS (SELECT n.*, quota, row_number() OVER (PARTITION BY gender ORDER BY name, hash) AS r FROM n JOIN q USING (gender)) SELECT hash, gender, name FROM k WHERE r <= quota""")
def voices_chosen(spark, d):
    every = _voices(spark, d).where("gender IS NOT NULL").withColumn("hash", F.md5(F.col("file").cast("binary")))
    wanted = every.select("hash", "gender", F.col("file").alias("name"))
    return P.chosen_clones(wanted, every.where("place % 5 = 0").select("hash"), 400)


@query(f"""WITH c AS ({C}) SELECT id, CASE id % 4 WHEN 0 THEN 'a; b' WHEN 1 THEN 'a' WHEN 2 THEN '{{not json' ELSE '' END AS summary FROM c""")
def quality_error_summary(spark, d):
    raw = F.element_at(F.array(F.lit('["a", "b", "c"]'), F.lit('["a"]'), F.lit("{not json"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return adapted(spark, d, CALLS).select("id", P.error_summary(raw).alias("summary"))


@query(f"""WITH c AS ({C}), r AS (SELECT id, id % 13 - 1 AS a, id % 17 AS b FROM c) SELECT id, CASE WHEN id % 6 <> 0 AND a >= 0 AND a < b AND b <= 15 THEN a END AS low, CASE WHEN id % 6 <> 0 AND a >= 0 AND a < b AND b <= 15 THEN b END AS high FROM r""")
def plan_range_bounds(spark, d):
    text = F.concat((F.col("id") % 13 - 1).cast("string"), F.when(F.col("id") % 6 == 0, "-").otherwise(":"), (F.col("id") % 17).cast("string"))
    return adapted(spark, d, CALLS).select("id", P.range_bounds(text, F.lit(15)).alias("x")).select("id", F.col("x.start").alias("low"), F.col("x.end").alias("high"))


@query(f"WITH f AS ({FR}) SELECT CASE WHEN count(*) FILTER (flag <> 0) = 0 THEN 1 ELSE 2 END AS phase FROM f")
def quality_phase(spark, d):
    return P.phase_of(adapted(spark, d, FRAMES))


@query(f"WITH c AS ({C}) SELECT count(*) AS total, count(*) FILTER (valid_n > 3) AS passed, count(*) FILTER (valid_n = 0) AS failed FROM c WHERE run_id = 'run2'")
def ops_unit_summary(spark, d):
    status = F.when(F.col("valid_n") > 3, "pass").when(F.col("valid_n") == 0, "fail")
    return P.unit_summary(adapted(spark, d, CALLS).withColumn("status", status), "run2")


@query(f"""WITH r AS ({R}), s AS (SELECT sum(CASE WHEN status = 'ok' THEN chars END) * 0.001e0 AS cost, sum(CASE WHEN status = 'ok' THEN duration_s END) / 3600e0 AS hours FROM r),
p AS (SELECT cost, cost + greatest(0, 5000 - hours) * cost / hours AS projected FROM s) SELECT round(projected, 4) AS projected, round(greatest(0, projected - cost), 4) AS gap, round(100 * projected * 83e0 / 200000e0, 6) AS budget_pct FROM p""")
def ops_projection(spark, d):
    ok = F.col("status") == "ok"
    spent = adapted(spark, d, RENDERS).agg((F.sum(F.when(ok, F.col("chars"))) * 0.001).alias("cost_usd"), (F.sum(F.when(ok, F.col("duration_s"))) / 3600.0).alias("hours"))
    found = P.projection(spent, 5000.0, 1.0, 200000.0, 83.0)
    return found.select(F.round("projected", 4).alias("projected"), F.round("gap", 4).alias("gap"), F.round("budget_pct", 6).alias("budget_pct"))


@query(f"""WITH r AS ({R}), n AS (SELECT count(*) FILTER (status = 'ok') AS k, count(*) AS done, max(created_at) - min(created_at) AS s FROM r)
SELECT round(k / (greatest(s, 5) / 60), 9) AS per_minute, round((2 * done - done) / (k / (greatest(s, 5) / 60)), 4) AS eta_min FROM n""")
def ops_progress(spark, d):
    counts = adapted(spark, d, RENDERS).agg(
        F.count_if(F.col("status") == "ok").alias("rendered"), F.count(F.lit(1)).alias("done"), (2 * F.count(F.lit(1))).alias("target"), (F.max("created_at") - F.min("created_at")).alias("elapsed_s"))
    return P.progress(counts).select(F.round("per_minute", 9).alias("per_minute"), F.round("eta_min", 4).alias("eta_min"))


@query(f"""WITH m AS ({M}) SELECT coalesce(lang, 'none') AS lang, CAST(GROUPING(lang) AS INT) AS total, round(sum(duration_s) / 3600, 6) AS hours, count(*) FILTER (doc_id % 2 = 0) AS encoded, count(*) FILTER (doc_id % 4 = 0) AS uploaded, count(*) FILTER (doc_id % 8 = 0) AS deleted
FROM m WHERE lang IS NOT NULL GROUP BY ROLLUP (lang)""")
def ops_language_counters(spark, d):
    clips = adapted(spark, d, MANIFEST).where("lang is not null").withColumns({"encoded": F.col("doc_id") % 2 == 0, "uploaded": F.col("doc_id") % 4 == 0, "deleted": F.col("doc_id") % 8 == 0})
    rows = P.counters_by_language(clips)
    return rows.select(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("lang").isNull().cast("int").alias("total"), "hours", "encoded", "uploaded", "deleted")


@query(f"""WITH f AS ({FR}) SELECT round(count(*) FILTER (pred = 3 AND flag <> 3) / CAST(count(*) FILTER (pred = 3) AS DOUBLE), 9) AS cutoff_rate,
round(count(*) FILTER (pred = 1 AND flag = 0) / CAST(count(*) FILTER (flag = 0) AS DOUBLE), 9) AS over_trigger, round(count(*) FILTER (pred = 7 AND flag = 7) / CAST(count(*) FILTER (pred = 7) AS DOUBLE), 9) AS prefetch_useful FROM f""")
def eval_rates(spark, d):
    t, p = F.col("flag"), F.col("pred")
    marks = {"early": (p == 3) & (t != 3), "ended": p == 3, "spoke": (p == 1) & (t == 0), "silent": t == 0, "useful": (p == 7) & (t == 7), "fetched": p == 7}
    counts = adapted(spark, d, FRAMES).select(*[c.cast("int").alias(n) for n, c in marks.items()])
    found = E.rates(counts, {"cutoff_rate": ("early", "ended"), "over_trigger": ("spoke", "silent"), "prefetch_useful": ("useful", "fetched")})
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(f"""WITH f AS ({FR}), g AS (SELECT clip, avg(abs(value)) AS a, avg(abs(value) + (event_id % 7 - 2) * 0.05e0) AS b FROM f GROUP BY clip)
SELECT clip, CASE WHEN a > 8 OR b - a < -0.05 THEN 'suspect' WHEN b - a < 0.05 THEN 'ignored' WHEN b - a < 0.3 THEN 'weak' ELSE 'used' END AS band FROM g""")
def eval_ablation(spark, d):
    losses = adapted(spark, d, FRAMES).groupBy("clip").agg(F.avg(F.abs("value")).alias("a"), F.avg(F.abs("value") + (F.col("event_id") % 7 - 2) * 0.05).alias("b"))
    return losses.select("clip", E.ablation_band(F.col("a"), F.col("b")).alias("band"))


@query(f"""WITH f AS ({FR}), g AS (SELECT clip, avg(value) AS ctrl, avg(event_id % 10) AS txt, avg(flag) AS vap FROM f GROUP BY clip)
SELECT clip, round(ctrl + 0.5e0 * txt + 0.2e0 * vap, 6) AS total, round(txt + 0.3e0 * vap, 6) AS first_phase FROM g""")
def eval_weighted_totals(spark, d):
    parts = adapted(spark, d, FRAMES).groupBy("clip").agg(F.avg("value").alias("ctrl"), F.avg(F.col("event_id") % 10).alias("txt"), F.avg("flag").alias("vap"))
    return parts.select(
        "clip", F.round(E.weighted_total({"ctrl": 1.0, "txt": 0.5, "vap": 0.2}), 6).alias("total"), F.round(E.weighted_total({"txt": 1.0, "vap": 0.3}), 6).alias("first_phase"))


@query(f"""WITH f AS ({FR}), b AS (SELECT *, list_extract(['barge_real', 'barge_lookalike', 'overlap_coop', 'backchannel', 'correction'], CAST(clip % 5 + 1 AS INT)) AS behaviour FROM f)
SELECT round(count(*) FILTER (behaviour IN ('barge_lookalike', 'overlap_coop', 'backchannel') AND pred IN (4, 5)) / CAST(count(*) FILTER (behaviour IN ('barge_lookalike', 'overlap_coop', 'backchannel')) AS DOUBLE), 9) AS false_barge_rate FROM b""")
def eval_false_barge(spark, d):
    behaviour = F.element_at(F.array(*map(F.lit, ("barge_real", "barge_lookalike", "overlap_coop", "backchannel", "correction"))), (F.col("clip") % 5 + 1).cast("int"))
    frames = adapted(spark, d, FRAMES).withColumn("behaviour", behaviour)
    return E.barge(frames, behaviour="behaviour").select(F.round("false_barge_rate", 9).alias("false_barge_rate"))


@query(f"""WITH f AS (SELECT *, valid AND CAST('0x' || substr(md5(concat_ws('|', 'drop', clip, frame)), 1, 5) AS BIGINT) / 1048576e0 >= 0.05e0 AS kept FROM ({FR}))
SELECT clip, count(*) AS frames, count(*) FILTER (valid) AS valid, count(*) FILTER (kept) AS kept FROM f GROUP BY clip""")
def frames_dropped(spark, d):
    """Frames kept of each clip where one in twenty valid ones is dropped."""
    rows = P.dropped_frames(adapted(spark, d, FRAMES), "clip", "frame")
    return rows.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("valid")).alias("valid"), F.count_if(F.col("kept")).alias("kept"))


@query("SELECT vec_id, greatest(1, CAST(round_even(len(embedding) * (vec_id % 10) / 10e0, 0) AS INT)) AS n, round(list_sum(list_transform(list_slice(embedding, 1, greatest(1, CAST(round_even(len(embedding) * (vec_id % 10) / 10e0, 0) AS INT))), lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def frames_proportional_trim(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", P.proportional_trim(F.col("embedding"), F.col("vec_id") % 10, F.lit(10.0)).alias("x"))
    return rows.select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("""WITH p AS (SELECT list_extract(['wav', 'ts', 'wav/x'], CAST(doc_id % 3 + 1 AS INT)) || '/b' || CAST(doc_id % 20 AS VARCHAR) || '/clip-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || CASE WHEN doc_id % 2 = 0 THEN '.parquet' ELSE '.wav' END AS path FROM documents)
SELECT path, CASE WHEN len(string_split(path, '/')) = 3 THEN string_split(path, '/')[2] END AS bucket, TRY_CAST(regexp_extract(path, '-(\\d+)[.]parquet$', 1) AS INT) AS shard FROM p""")
def sources_shard_numbers(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("wav", "ts", "wav/x"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(head, F.lit("/b"), (F.col("doc_id") % 20).cast("string"), F.lit("/clip-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.when(F.col("doc_id") % 2 == 0, ".parquet").otherwise(".wav"))
    paths = spark.read.parquet(f"{d}/documents.parquet").select(path.alias("path"))
    buckets = P.bucket_names(paths)
    named = paths.withColumn("bucket", F.when(F.size(F.split("path", "/")) == 3, F.split("path", "/")[1]))
    return named.join(F.broadcast(buckets.withColumnRenamed("bucket", "known")), F.col("bucket") == F.col("known"), "left").select("path", F.col("known").alias("bucket"), P.shard_number(F.col("path")).alias("shard"))


@query(f"""WITH {VOICES}, w AS (SELECT {GENDER} AS gender, file AS name, regexp_extract(file, '_(.*)[.]wav', 1) AS voice, place FROM v WHERE {GENDER} IS NOT NULL),
o AS (SELECT gender, name, row_number() OVER (PARTITION BY gender ORDER BY name) AS k FROM w WHERE place % 3 = 0),
g AS (SELECT gender, voice, row_number() OVER (PARTITION BY gender ORDER BY place, voice) AS k FROM w WHERE (place % 4 = 1 OR place % 8 = 0) AND place % 5 <> 1)
SELECT o.gender, name, voice FROM o LEFT JOIN g ON g.gender = o.gender AND g.k = o.k""")
def voices_filled(spark, d):
    """Places that get no clone of their own take the unused voices of a catalogue, place by place."""
    every = _voices(spark, d).where("gender IS NOT NULL").withColumn("hash", F.md5(F.col("file").cast("binary")))
    catalogue = every.where("place % 4 = 1 OR place % 8 = 0").select("gender", "voice", F.col("place"))
    return P.default_fill(every.where("place % 3 = 0").select("gender", F.col("file").alias("name"), "hash"), catalogue, every.where("place % 5 = 1"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) || '.json' AS name, 'moved' AS state FROM events")
def files_moved(spark, d):
    """A file a user, in folders by the user's hash, moved out of them into one by tasks; moved again, none is."""
    from ..sources import moves
    from ..streaming.live import shared_path

    path = shared_path(spark, "moves")
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("none"))
    file = F.concat(F.pmod(F.crc32(user.cast("binary")), F.lit(200)).cast("string"), F.lit("/user_id="), user, F.lit(".json"))
    events = spark.read.parquet(f"{d}/events.parquet").select(file.alias("name"), F.to_json(F.struct("event_id", "value")).alias("line"))
    moves.write_lines(events, f"{path}/in").write.parquet(f"{path}/written")
    name = F.concat(F.regexp_extract("path", r"user_id=(\d+)", 1), F.lit(".json"))
    for k in range(2):
        moves.moved_flat(spark, f"{path}/in", "*.json", f"{path}/out", name).write.parquet(f"{path}/report{k}")
    first, again = (spark.read.parquet(f"{path}/report{k}") for k in range(2))
    return first.unionByName(again).select("name", "state")
