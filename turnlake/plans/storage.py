"""Queries of joins, resume, dedupe and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import md5_mod
from ..operators import storage as W
from ..sources.adapters import CALLS, RENDERS, SCENARIOS, adapted, oracle
from .allocation import _md5_mod
from .registry import query

C, R, S = oracle(CALLS), oracle(RENDERS), oracle(SCENARIOS)


@query("SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id")
def dedupe_last_write(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return W.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY ALL")
def dedupe_first_seen(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "ts")
    return W.earliest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return W.pending(docs.select("doc_id", "lang"), labels, "doc_id")


@query("SELECT count(*) AS done, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def resume_done_meter(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("done"), F.sum("n_chars").alias("chars"))


@query(f"WITH r AS ({R}) SELECT id, status, CASE WHEN status = 'ok' AND duration_s > 20 THEN chars + 1000 ELSE chars END AS chars FROM r")
def storage_correct(spark, d):
    renders = adapted(spark, d, RENDERS)
    rows = renders.select("id", "status", "chars")
    fixes = renders.where("duration_s > 20").select("id", (F.col("chars") + 1000).alias("new_value"))
    return W.corrected(rows, fixes, "id", "chars").select("id", "status", "chars")


@query(f"WITH r AS ({R}) SELECT scenario_id, 'bucket_' || lpad(CAST({_md5_mod('scenario_id', 200)} AS VARCHAR), 3, '0') || '/' || scenario_id AS path FROM r")
def storage_bucket_path(spark, d):
    return adapted(spark, d, RENDERS).select("scenario_id", W.bucket_path(F.col("scenario_id")).alias("path"))


@query(f"WITH j AS (SELECT DISTINCT job_key FROM ({C})) SELECT job_key, CAST((row_number() OVER (ORDER BY job_key) - 1) // 3 AS BIGINT) AS pack, CAST((row_number() OVER (ORDER BY job_key) - 1) % 4 AS INT) AS worker FROM j")
def storage_pack(spark, d):
    jobs = adapted(spark, d, CALLS).select("job_key").distinct()
    return W.round_robin(W.packed(jobs, "job_key", 3, 10), "job_key", 4)


@query(f"""WITH s AS ({S}) SELECT scenario_id, CASE WHEN l.doc_id IS NOT NULL THEN 'encoded' WHEN d.doc_id IS NOT NULL THEN 'words' ELSE 'estimate' END AS timing FROM s
LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = conv_id LEFT JOIN labels l ON l.doc_id = conv_id""")
def join_sidecars(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    words = docs.where("lang = 'en'").select(F.col("doc_id").alias("conv_id"), (F.col("n_chars") / 100.0).alias("duration_s"))
    encoded = labels.select(F.col("doc_id").alias("conv_id"), F.col("quality").alias("frames"))
    return W.joined_sidecars(adapted(spark, d, SCENARIOS), words, encoded, "conv_id").select("scenario_id", "timing")


@query(f"WITH c AS ({C}), r AS (SELECT * FROM (VALUES ('run0', 'plan'), ('run1', 'generate'), ('run3', 'render')) t(run_id, stage)) SELECT stage, count(*) AS calls FROM c JOIN r USING (run_id) GROUP BY stage")
def join_runs(spark, d):
    runs = spark.sql("SELECT * FROM (VALUES ('run0', 'plan'), ('run1', 'generate'), ('run3', 'render')) AS t(run_id, stage)")
    return adapted(spark, d, CALLS).join(F.broadcast(runs), "run_id").groupBy("stage").agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT a.doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en') a INTERSECT SELECT doc_id FROM labels")
def set_collisions(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.where("lang = 'en'").select("doc_id").intersect(labels.select("doc_id"))


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels")
def set_union_all(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select(F.col("doc_id").alias("id")).union(labels.select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
def set_difference(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id").exceptAll(labels.where("toxic = 0").select("doc_id")).distinct()


@query("SELECT source, max_by(doc_id, struct_pack(a := CAST(lang = 'en' AS INT), b := n_chars, c := doc_id)) AS doc_id FROM documents GROUP BY source")
def topk_preferred(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.groupBy("source").agg(F.max_by("doc_id", F.struct((F.col("lang") == "en").cast("int"), "n_chars", "doc_id")).alias("doc_id"))


@query(f"WITH c AS ({C}) SELECT job_key, count(*) AS have FROM c WHERE valid_n > 0 GROUP BY job_key")
def resume_job_counts(spark, d):
    return adapted(spark, d, CALLS).where("valid_n > 0").groupBy("job_key").agg(F.count(F.lit(1)).alias("have"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events")
def storage_row_counts(spark, d):
    parts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "labels", "events")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT page_id, regexp_extract(url, '([a-z.]+)/', 1) AS host, TRY_CAST(regexp_extract(url, '(\\d+)', 1) AS INT) AS number FROM pages")
def sources_path_parts(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    number = F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit(""))
    return pages.select("page_id", F.regexp_extract("url", "([a-z.]+)/", 1).alias("host"), number.try_cast("int").alias("number"))


@query(f"WITH r AS ({R}) SELECT scenario_id, substr(md5(scenario_id), 1, 2) || '/' || scenario_id AS path FROM r")
def storage_hex_path(spark, d):
    return adapted(spark, d, RENDERS).select("scenario_id", W.hex_path(F.col("scenario_id")).alias("path"))


SAVED = "SELECT user_id AS folder, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'final' ELSE 'step' || CAST(event_id AS STRING) END AS tag, event_id AS saved_at FROM {events} WHERE event_id % 5 <> 1 OR user_id % 2 = 0"


@query(f"""WITH s AS ({SAVED.replace('{events}', 'events').replace('AS STRING', 'AS VARCHAR')})
SELECT 'single' AS mode, folder, tag, saved_at FROM s WHERE tag = '' UNION ALL SELECT 'all', folder, tag, saved_at FROM s WHERE tag <> '' UNION ALL
SELECT 'final', folder, tag, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY tag = 'final' DESC, saved_at DESC, tag DESC) AS k FROM s WHERE tag <> '') WHERE k = 1""")
def topk_checkpoints(spark, d):
    saved = adapted(spark, d, SAVED)
    found = [W.checkpoints(saved, m, at="saved_at").select(F.lit(m).alias("mode"), "folder", "tag", "saved_at") for m in ("single", "all", "final")]
    return found[0].unionByName(found[1]).unionByName(found[2])
