"""Queries of the audit family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import BEHAVIOURS, FLAGS, LANGUAGES
from ..operators import audits as A
from ..sources.adapters import FRAMES, MANIFEST, SCENARIOS, TARGETS, adapted, oracle
from .registry import query

FR, M, S, T = oracle(FRAMES), oracle(MANIFEST), oracle(SCENARIOS), oracle(TARGETS)
COVER = f"""f AS ({FR}), k AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS flag), g AS (SELECT flag, count(*) AS frames, count(DISTINCT clip) AS clips FROM f GROUP BY flag),
v AS (SELECT k.flag, coalesce(frames, 0) AS frames, coalesce(clips, 0) AS clips FROM k LEFT JOIN g USING (flag))"""
SHORT = COVER + ", sh AS (SELECT flag, list_extract([" + ", ".join(f"'{f}'" for f in FLAGS) + "], flag + 1) AS name, 200 - clips AS short FROM v WHERE clips < 200)"
BRIDGE = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{x}', {2 if i == 0 else 1})" for f, xs in A.PRODUCERS.items() for i, x in enumerate(xs)) + ") t(name, behaviour, weight))"


def _cover(spark, d):
    return A.coverage(adapted(spark, d, FRAMES))


@query(f"WITH {COVER} SELECT flag, frames, clips, round(frames / CAST(sum(frames) OVER () AS DOUBLE), 9) AS share FROM v")
def audit_coverage(spark, d):
    return _cover(spark, d).withColumn("share", F.round("share", 9))


@query(f"WITH {SHORT} SELECT * FROM sh")
def audit_deficits(spark, d):
    return A.deficits(_cover(spark, d), 200)


@query(f"""WITH {SHORT}, {BRIDGE}, p AS (SELECT *, weight / CAST(sum(weight) OVER (PARTITION BY name) AS DOUBLE) AS part FROM b), n AS (SELECT behaviour, sum(short * part) AS need FROM sh JOIN p USING (name) GROUP BY 1)
SELECT behaviour, round(need / sum(need) OVER (), 4) AS share FROM n""")
def audit_behaviour_shares(spark, d):
    return A.behaviour_shares(A.deficits(_cover(spark, d), 200))


@query(f"""WITH s AS ({S}), t AS ({T}), c AS (SELECT flag, behaviour, count(*) AS n FROM t JOIN s USING (scenario_id) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY n DESC, behaviour) AS place FROM c)
SELECT * FROM p WHERE place <= 2""")
def audit_top_producers(spark, d):
    joined = adapted(spark, d, TARGETS).join(adapted(spark, d, SCENARIOS).select("scenario_id", "behaviour"), "scenario_id")
    return A.top_producers(joined, "flag", "behaviour")


@query(f"WITH m AS ({M}), q AS (SELECT *, coalesce(sum(duration_s) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT id, lang, duration_s FROM q WHERE before < 600")
def audit_quota_fill(spark, d):
    return A.quota_filled(adapted(spark, d, MANIFEST), ["lang"], "doc_id", "duration_s", 600.0, span=256).select("id", "lang", "duration_s")


@query(f"WITH m AS ({M}) SELECT lang, source, count(*) AS clips, round(sum(duration_s) / 3600, 6) AS hours, count(*) FILTER (lower(gender) LIKE 'f%') AS female, count(*) FILTER (lower(gender) LIKE 'm%') AS male FROM m GROUP BY lang, source")
def audit_manifest_stats(spark, d):
    return A.manifest_stats(adapted(spark, d, MANIFEST))


@query(f"WITH f AS ({FR}), c AS (SELECT clip, sum(CAST(flag = 1 AS INT)) AS s, count(*) AS n FROM f GROUP BY clip) SELECT round(sum(s) / CAST(sum(n) AS DOUBLE), 6) AS rate, round(quantile_cont(s / CAST(n AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(s / CAST(n AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(s / CAST(n AS DOUBLE), 0.9), 6) AS p90 FROM c")
def audit_speaking_rate(spark, d):
    return A.speaking_rates(adapted(spark, d, FRAMES).withColumn("on", (F.col("flag") == 1).cast("int")), "clip", "on")


@query(f"WITH {COVER} SELECT flag, CASE WHEN frames = 0 THEN 'degenerate' WHEN frames / CAST(sum(frames) OVER () AS DOUBLE) < 0.02 OR frames / CAST(sum(frames) OVER () AS DOUBLE) > 0.98 THEN 'degenerate' WHEN frames < 500 THEN 'rare' ELSE 'fine' END AS verdict FROM v")
def audit_verdicts(spark, d):
    from pyspark.sql import Window

    total = F.sum("frames").over(Window.partitionBy())
    return _cover(spark, d).select("flag", A.verdict(F.col("share"), F.col("frames"), total).alias("verdict"))


@query("WITH l AS (SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'extended' ELSE 'long' END AS band, n_chars, d.doc_id, labels.doc_id IS NOT NULL AS rendered FROM documents d LEFT JOIN labels ON labels.doc_id = d.doc_id) SELECT coalesce(band, 'total') AS band, count(*) AS n, count(*) FILTER (rendered) AS rendered, round(sum(CASE WHEN rendered THEN n_chars / 100e0 ELSE 0 END), 4) AS real_s, round(sum(CASE WHEN rendered THEN n_chars / 100e0 ELSE greatest(1, n_chars / 6e0) / 2.2e0 END), 4) AS projected_s FROM l GROUP BY ROLLUP (band)")
def audit_hours_by_band(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "extended").otherwise("long")
    done = labels.select("doc_id", F.lit(True).alias("done"))
    rows = docs.select("doc_id", "n_chars", band.alias("band")).join(done, "doc_id", "left").withColumn("rendered", F.coalesce("done", F.lit(False)))
    real = F.col("n_chars") / 100.0
    return rows.rollup("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("rendered").alias("rendered"), F.round(F.sum(F.when(F.col("rendered"), real).otherwise(0.0)), 4).alias("real_s"),
        F.round(F.sum(F.when(F.col("rendered"), real).otherwise(F.greatest(F.lit(1.0), F.col("n_chars") / 6.0) / 2.2)), 4).alias("projected_s")).withColumn("band", F.coalesce("band", F.lit("total")))


@query(f"WITH {SHORT} SELECT round(greatest(0.1e0, coalesce(max(short), 0) * 22e0 / 3600), 6) AS hours FROM sh")
def audit_topup_hours(spark, d):
    return A.topup_hours(A.deficits(_cover(spark, d), 200))


@query("SELECT doc_id, quality FROM labels ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def audit_judge_sample(spark, d):
    return A.hash_sample(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id", 50)


@query("""WITH c AS (SELECT vec_id, list_avg(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END)) AS rate FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 400)
SELECT round(avg(rate), 9) AS rate, count(*) AS clips FROM c""")
def audit_rate_sample(spark, d):
    clips = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("track"))
    return A.speaking_rate_sample(clips, "vec_id", "track").withColumn("rate", F.round("rate", 9))


BEHAVED = f"f AS (SELECT clip, frame, flag, split_part('{','.join(BEHAVIOURS)}', ',', CAST(clip % 12 + 1 AS INT)) AS behaviour, split_part('{','.join(LANGUAGES)}', ',', CAST(clip % 5 + 1 AS INT)) AS language, event_id % 97 = 0 AS spoken FROM ({oracle(FRAMES)}))"
NAMES = ", ".join(f"'{x}'" for x in FLAGS)


@query(f"""WITH {BEHAVED}, n AS (SELECT [{NAMES}][flag + 1] AS name, count(*) AS frames, count(DISTINCT clip) AS clips FROM f GROUP BY 1),
b AS (SELECT behaviour, count(DISTINCT clip) AS clips FROM f GROUP BY 1), l AS (SELECT language, count(DISTINCT clip) AS clips FROM f GROUP BY 1),
e AS (SELECT name, 100 - coalesce(clips, 0) AS short FROM (SELECT unnest([{NAMES}]) AS name) LEFT JOIN n USING (name) WHERE 100 - coalesce(clips, 0) > 0)
SELECT (SELECT count(DISTINCT clip) FROM f) AS clips, (SELECT count(*) FROM f) AS frames, (SELECT round(count(*) / 45000e0, 2) FROM f) AS hours,
  (SELECT count(DISTINCT clip) FROM f WHERE spoken) AS clips_with_spoken_text, (SELECT string_agg(name || '=' || frames, ' ' ORDER BY name) FROM n) AS frame_counts,
  (SELECT string_agg(name || '=' || clips, ' ' ORDER BY name) FROM n) AS clip_counts, (SELECT string_agg(behaviour || '=' || clips, ' ' ORDER BY behaviour) FROM b) AS by_behaviour,
  (SELECT string_agg(language || '=' || clips, ' ' ORDER BY language) FROM l) AS by_language, (SELECT string_agg(name || '=' || short, ' ' ORDER BY name) FROM e) AS deficits""")
def audit_report(spark, d):
    """The corpus as one JSON text, from one grouping of its frames; here read back into columns."""
    of = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("clip") % by + 1).cast("int"))
    frames = adapted(spark, d, FRAMES).select("clip", "frame", "flag", of(BEHAVIOURS, 12).alias("behaviour"), of(LANGUAGES, 5).alias("language"), (F.col("event_id") % 97 == 0).alias("spoken"))
    maps = ["frame_counts", "clip_counts", "by_behaviour", "by_language", "deficits"]
    schema = "clips long, frames long, hours double, clips_with_spoken_text long, " + ", ".join(f"{m} map<string, long>" for m in maps)
    read = A.corpus_report(frames, least_clips=100).select(F.from_json("report", schema).alias("r")).select("r.*")
    listed = lambda m: F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " "), F.lit(""))
    return read.withColumns({m: listed(m) for m in maps})
