"""Queries of the planning family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import half_even, md5_mod
from ..operators import allocation as A
from ..sources.adapters import CALLS, MANIFEST, adapted, oracle
from .registry import query

#: Shares of the default plan (fixed values): behaviours with their kind's share and their part of it, languages, domains.
BEHAVIOUR_SHARES = [
    ("endpoint_end", 0.24, 0.6), ("endpoint_hold", 0.24, 0.4), ("barge_real", 0.16, 0.5), ("barge_lookalike", 0.16, 0.5), ("backchannel", 0.12, 1.0),
    ("overlap_comp", 0.12, 0.5), ("overlap_coop", 0.12, 0.5), ("incomplete_thinking", 0.10, 1.0), ("correction", 0.08, 1.0), ("silence_break", 0.06, 1.0),
    ("prefetch", 0.06, 1.0), ("nonspeech_neg", 0.06, 1.0),
]
LANGUAGE_SHARES = [("hi", 0.30), ("en", 0.26), ("gu", 0.24), ("hi_en_native", 0.10), ("gu_en_native", 0.10)]
DOMAIN_SHARES = [("sales", 0.40), ("bfsi_collections", 0.35), ("support", 0.25)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}e0" for x in row) + ")" for row in rows)


#: A plan for as many scenarios as the calls asked for: behaviours by the default shares, languages and domains as they occur in the jobs.
DIMS = f"""WITH c AS ({CALLS}),
j AS (SELECT split_part(job_key, '|', 2) AS language, split_part(job_key, '|', 3) AS domain, count(*) AS n, sum(requested_n) AS wanted FROM c GROUP BY 1, 2),
x AS (SELECT language, domain, CAST(sum(n) OVER (PARTITION BY language) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS l_share,
  CAST(sum(n) OVER (PARTITION BY domain) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS d_share, CAST(sum(wanted) OVER () AS DOUBLE) AS total FROM j)
SELECT behaviour, language, domain, k_share, b_share, l_share, d_share, total
  FROM x CROSS JOIN (VALUES {_values(BEHAVIOUR_SHARES)}) AS b(behaviour, k_share, b_share)"""
PLAN_SQL = f"""dims AS ({oracle(DIMS)}),
cells AS (SELECT *, CAST(round_even(CAST(round_even(CAST(round_even(CAST(round_even(total * k_share, 0) AS DOUBLE) * b_share, 0) AS DOUBLE) * l_share, 0) AS DOUBLE) * d_share, 0) AS BIGINT) AS n FROM dims),
gendered AS (SELECT behaviour, language, domain, 'female' AS gender, n // 2 AS c FROM cells UNION ALL SELECT behaviour, language, domain, 'male', n - n // 2 FROM cells),
quiet AS (SELECT *, CASE WHEN behaviour = 'backchannel' AND c >= 2 THEN CAST(round_even(c * 0.35e0, 0) AS BIGINT) ELSE 0 END AS s FROM gendered),
plan AS (SELECT behaviour, language, domain, gender, false AS force_silence, c - s AS count FROM quiet WHERE c - s > 0
  UNION ALL SELECT behaviour, language, domain, gender, true, s FROM quiet WHERE s > 0)"""
KEY_SQL = "behaviour || '|' || language || '|' || domain || '|' || gender || '|' || CAST(CAST(force_silence AS INT) AS VARCHAR)"


def _md5_mod(key: str, n: int) -> str:
    half = "CAST(CAST(('0x' || substr(md5({k}), {at}, 16)) AS UBIGINT) AS HUGEINT)"
    return f"CAST(({half.format(k=key, at=1)} % {n} * {(1 << 64) % n} + {half.format(k=key, at=17)} % {n}) % {n} AS INT)"


def default_plan(spark, total: int = 9000):
    """The plan of the default shares, which reads no table."""
    return A.build_plan(spark.sql(f"""SELECT * FROM (VALUES {_values(BEHAVIOUR_SHARES)}) AS b(behaviour, k_share, b_share)
      CROSS JOIN (VALUES {_values(LANGUAGE_SHARES)}) AS l(language, l_share) CROSS JOIN (VALUES {_values(DOMAIN_SHARES)}) AS d(domain, d_share)"""), total)


def _plan(spark, sf_dir):
    return A.build_plan(adapted(spark, sf_dir, DIMS), F.col("total"))


@query(f"""WITH m AS ({oracle(MANIFEST)}), h AS (SELECT lang, sum(length(transcript)) AS chars FROM m GROUP BY lang)
SELECT lang, CAST(greatest(1, round_even(chars / 15e0 / 22e0, 0)) AS BIGINT) AS total, round(chars / 15e0 / 3600e0, 6) AS hours FROM h""")
def plan_total(spark, sf_dir):
    """Scenarios of 22 s that fill each language's hours, at 15 characters a second."""
    chars = adapted(spark, sf_dir, MANIFEST).groupBy("lang").agg(F.sum(F.length("transcript")).alias("chars"))
    return chars.select("lang", F.greatest(F.lit(1), half_even(F.col("chars") / 15.0 / 22.0)).alias("total"), F.round(F.col("chars") / 15.0 / 3600.0, 6).alias("hours"))


@query(f"WITH {PLAN_SQL} SELECT * FROM plan")
def plan_build(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""WITH {PLAN_SQL}, s AS (SELECT behaviour, language, gender, sum(count) AS n, sum(CASE WHEN force_silence THEN count ELSE 0 END) AS silent
FROM plan GROUP BY GROUPING SETS ((behaviour), (language), (gender), ()))
SELECT CASE WHEN behaviour IS NOT NULL THEN 'behaviour' WHEN language IS NOT NULL THEN 'language' WHEN gender IS NOT NULL THEN 'gender' ELSE 'total' END AS kind,
coalesce(behaviour, language, gender, 'all') AS name, CAST(n AS BIGINT) AS n, CAST(silent AS BIGINT) AS silent FROM s""")
def plan_summary(spark, sf_dir):
    return A.plan_summary(_plan(spark, sf_dir))


@query(f"WITH {PLAN_SQL} SELECT {KEY_SQL} AS job_key, count, {_md5_mod(KEY_SQL, 8)} AS part FROM plan")
def plan_partition_md5(spark, sf_dir):
    return A.partition_plan(_plan(spark, sf_dir), 8).select("job_key", "count", "part")


@query(f"""WITH {PLAN_SQL}, keyed AS (SELECT {KEY_SQL} AS job_key, count FROM plan)
SELECT job_key, CAST(sum(count) OVER (ORDER BY job_key) - count AS BIGINT) AS start_index, CAST(sum(count) OVER (ORDER BY job_key) AS BIGINT) AS end_index FROM keyed""")
def plan_index_spans(spark, sf_dir):
    keyed = A.partition_plan(_plan(spark, sf_dir), 8)
    return A.index_spans(keyed, "job_key", "count").select("job_key", "start_index", "end_index")


@query(f"""WITH {PLAN_SQL}, keyed AS (SELECT {KEY_SQL} AS job_key, count FROM plan),
s AS (SELECT job_key, CAST(sum(count) OVER (ORDER BY job_key) - count AS BIGINT) AS a, CAST(sum(count) OVER (ORDER BY job_key) AS BIGINT) AS b FROM keyed)
SELECT job_key, greatest(a, 1000) AS lo, least(b, 2500) AS hi FROM s WHERE least(b, 2500) > greatest(a, 1000)""")
def plan_range_overlap(spark, sf_dir):
    spans = A.index_spans(A.partition_plan(_plan(spark, sf_dir), 8), "job_key", "count")
    return A.spans_in_range(spans, 1000, 2500).select("job_key", "lo", "hi")


@query("""WITH w AS (SELECT lang AS name, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents GROUP BY lang),
x AS (SELECT *, weight * 20 / CAST(sum(weight) OVER () AS DOUBLE) AS e FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, name) AS k, 20 - sum(floor(e)) OVER () AS rest FROM x)
SELECT name, weight, CAST(floor(e) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def plan_largest_remainder(spark, sf_dir):
    weights = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("lang").alias("name")).agg(F.sum("n_chars").alias("weight"))
    return A.largest_remainder(weights, 20)


@query("WITH w AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM w")
def plan_share_normalise(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return A.normalised(counts, "n").withColumn("share", F.round("share", 9))


@query(f"WITH m AS ({oracle(MANIFEST)}) SELECT id, substr(md5(lang || '|' || source || '|' || id), 1, 16) AS clip_id FROM m")
def plan_deterministic_id(spark, sf_dir):
    return adapted(spark, sf_dir, MANIFEST).select("id", A.deterministic_id(F.col("lang"), F.col("source"), F.col("id")).alias("clip_id"))


@query(f"WITH m AS ({oracle(MANIFEST)}) SELECT id, 'voice' || CAST({_md5_mod('id', 7)} AS VARCHAR) AS voice FROM m")
def plan_voice_rotation(spark, sf_dir):
    return adapted(spark, sf_dir, MANIFEST).select("id", F.concat(F.lit("voice"), md5_mod(F.col("id"), 7).cast("string")).alias("voice"))


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('s1|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p < floor(n * 0.8e0) THEN 'train' WHEN p < floor(n * 0.8e0) + floor(n * 0.1e0) THEN 'val' ELSE 'test' END AS split FROM h""")
def plan_random_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return A.random_split(docs, "doc_id", "s1", 0.8, 0.1)


@query(f"""WITH c AS (SELECT id, run_id, id // 5 AS step FROM ({oracle(CALLS)})), e AS (SELECT run_id, max(step) + 1 AS total, (max(step) + 1) // 10 AS warmup FROM c GROUP BY run_id)
SELECT id, run_id, CAST(step AS BIGINT) AS step, round(CASE WHEN step < warmup THEN step / CAST(greatest(1, warmup) AS DOUBLE)
  ELSE 0.5e0 * (1 + cos(pi() * least(1e0, (step - warmup) / CAST(greatest(1, total - warmup) AS DOUBLE)))) END, 6) AS rate FROM c JOIN e USING (run_id)""")
def plan_warmup_cosine(spark, sf_dir):
    """The learning rate at every step of each run, whose first tenth warms up; one row a run meets the steps."""
    steps = adapted(spark, sf_dir, CALLS).select("id", "run_id", F.floor(F.col("id") / 5).alias("step"))
    ends = steps.groupBy("run_id").agg((F.max("step") + 1).alias("total")).withColumn("warmup", F.floor(F.col("total") / 10))
    rate = A.warmup_cosine(F.col("step"), F.col("warmup"), F.col("total"))
    return steps.join(ends, "run_id").select("id", "run_id", "step", F.round(rate, 6).alias("rate"))


@query(f"""WITH c AS ({oracle(CALLS)}), k AS (SELECT job_key, count(*) AS n FROM c GROUP BY job_key)
SELECT job_key, n, CAST((row_number() OVER (ORDER BY job_key) - 1) // 4 AS BIGINT) AS batch FROM k""")
def plan_batches(spark, sf_dir):
    from pyspark.sql import Window

    jobs = adapted(spark, sf_dir, CALLS).groupBy("job_key").agg(F.count(F.lit(1)).alias("n"))
    return jobs.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("job_key")) - 1) / 4))


@query(f"""WITH {PLAN_SQL} SELECT {KEY_SQL} AS job_key, 'Write ' || count || ' ' || behaviour || ' dialogues in ' || language || ' for ' || domain || ', caller ' || gender ||
CASE WHEN force_silence THEN '; the right answer is silence.' ELSE '.' END AS prompt FROM plan""")
def plan_prompts(spark, sf_dir):
    keyed = A.partition_plan(_plan(spark, sf_dir), 8)
    return keyed.select("job_key", A.prompt().alias("prompt"))
