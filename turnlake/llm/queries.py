"""The registered queries of this subpackage: thin, each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(n: int, remainder: int) -> Column:
    """Whether the row is of the fold that nothing is learned from; false for a null id, which no label or fold has."""
    return F.coalesce(crc_fold(F.col("doc_id"), n) == remainder, F.lit(False)).alias("held_out")


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learned from the labelled rows of docs that are not held out."""
    from .toxicity import learn_lexicon

    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), 3) != 1)).select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    return learn_lexicon(docs.select(F.col("doc_id").alias("id"), "text"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import learn_network, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = learn_network(docs.where(crc_fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = predict_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(5, 0), "lang_pred", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)[1]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import minimax_shards, text_group, text_size

    text = F.col("text")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_group(text).alias("grp"))
    rows = cut(narrow)  # texts are read once, and none is shuffled
    placed = minimax_shards(rows, shards=8, group_col="grp", size_col="size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pareto_mix, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = pareto_mix(cut(docs), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_search import top_products

    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP3_SQL = r"""
WITH norm AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM best
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':pareto-1'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         3.0::DOUBLE * source_size AS cap FROM per_source),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT coalesce((SELECT level FROM levels WHERE cap / weight >= level ORDER BY cap / weight, level LIMIT 1), 'inf'::DOUBLE) AS level),
targets AS (SELECT l.source, source_size, n, least(cap, c.level * weight) AS target FROM levels l, chosen c),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
goals2 AS (
  SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS missing,
         greatest(1.0::DOUBLE, source_size::DOUBLE / n) AS mean FROM goals),
sizes AS (SELECT source, size, count(*) AS k FROM sized WHERE size > 0 GROUP BY source, size),
sums AS (
  SELECT *, coalesce(sum(size * k) OVER larger, 0) AS certain, sum(size * k) OVER (PARTITION BY source) AS whole_1,
         coalesce(sum(size::HUGEINT * size * k) OVER larger, 0) AS certain_2, sum(size::HUGEINT * size * k) OVER (PARTITION BY source) AS whole_2
  FROM sizes WINDOW larger AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tried AS (
  SELECT z.source, z.size, (g.missing - certain) / (0.5::DOUBLE * (whole_1 - certain) + 0.5::DOUBLE * CAST(whole_2 - certain_2 AS DOUBLE) / g.mean) AS factor, g.mean
  FROM sums z JOIN goals2 g ON z.source IS NOT DISTINCT FROM g.source),
factors AS (SELECT source, arg_max(factor, size) AS factor FROM tried WHERE factor * (0.5::DOUBLE + 0.5::DOUBLE * size / mean) <= 1.0 GROUP BY source),
odds AS (
  SELECT g.*, greatest(coalesce(f.factor, 0.0::DOUBLE), 1.0::DOUBLE / 1048576) AS odds FROM goals2 g LEFT JOIN factors f ON g.source IS NOT DISTINCT FROM f.source),
p AS (
  SELECT s.doc_id, s.size, s.u, o.*, least(1.0::DOUBLE, odds * (0.5::DOUBLE + 0.5::DOUBLE * s.size / mean)) AS p
  FROM sized s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source),
q AS (SELECT *, CASE WHEN p >= 1.0 THEN 0.0::DOUBLE ELSE (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM p),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1.0::DOUBLE + q), doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM q),
best AS (SELECT source, min(abs(upto - missing)) AS off, any_value(missing) AS missing FROM ranked GROUP BY source),
ends AS (
  SELECT r.source, min(CASE WHEN abs(r.upto - r.missing) = b.off THEN r.upto END) AS upto, any_value(b.off) < any_value(b.missing) AS some
  FROM ranked r JOIN best b ON r.source IS NOT DISTINCT FROM b.source GROUP BY r.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN e.some AND r.upto <= e.upto THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, rowid AS r, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c
  FROM (SELECT vec_id, embedding, row_number() OVER () AS rowid FROM embeddings)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r AS q, o.vec_id, o.r, CAST(list_inner_product(q.c, o.c) AS BIGINT) AS score
  FROM v q JOIN v o ON len(q.c) = len(o.c) AND q.r <> o.r WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
grams AS (SELECT lang, w[i:i + k] AS g FROM placed CROSS JOIN (SELECT unnest(range(0, 5)) AS k) WHERE i + k <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
subs AS (
  SELECT lang, f, g, unnest(range(1, len(g) + 1)) AS s FROM f WHERE len(g) > 2),
inside AS (
  SELECT lang, g[s:s + m] AS sub, max(f) AS longer FROM subs CROSS JOIN (SELECT unnest(range(1, 4)) AS m)
  WHERE s + m <= len(g) AND m + 1 < len(g) GROUP BY ALL),
kept AS (
  SELECT f.* FROM f LEFT JOIN inside i ON f.lang = i.lang AND f.g = i.sub WHERE len(f.g) > 1 AND coalesce(100 * i.longer < 100 * f.f, true)),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, lf.f AS l, rf.f AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (lf.f::HUGEINT * rf.f) AS BIGINT) AS score
  FROM cuts c JOIN f lf ON lf.lang = c.lang AND lf.g = c.g[1:c.k] JOIN f rf ON rf.lang = c.lang AND rf.g = c.g[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM lowest)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_ngram_join, op2_decontaminate, op3_exact_dedup, op4_toxicity, op5_html_text, op6_licenses, op7_language_id, op8_token_files, op9_sharding, op10_mixing,
        op11_top_products, op12_collocations, op13_fill_middle,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op10_mixing": OP10_SQL, "op11_top_products": OP11_SQL, "op12_collocations": OP12_SQL, "op13_fill_middle": OP13_SQL}
