"""What is rendered, published and kept: routing, miss counts, portable paths, voices, scoped deletion, plan and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import blank, half_even, md5_mod

#: What a job of the plan holds.
JOB_SCHEMA = "behaviour string, language string, domain string, gender string, count int, force_silence boolean, length_band string"


def publishable(clips: DataFrame, synced: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Clips with audio, metadata, a duration above 0 and a text that have not been published yet."""
    ready = clips.where(F.col("has_wav") & F.col("has_meta") & (F.coalesce("duration_s", F.lit(0.0)) > 0) & ~blank(F.col("user_text")))
    return ready.join(synced.select(key).distinct(), key, "left_anti")


def matched(wavs: DataFrame, scenarios: DataFrame, timestamps: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Sound files with their scenario, and their timestamps where there are any."""
    return wavs.join(scenarios, key).join(timestamps.withColumn("has_timestamps", F.lit(True)), key, "left").withColumn("has_timestamps", F.coalesce("has_timestamps", F.lit(False)))


def misses(wavs: DataFrame, scenarios: DataFrame, timestamps: DataFrame, key: str = "scenario_id") -> DataFrame:
    """One row: sound files, those without a scenario, and those with one but without timestamps."""
    marks = wavs.select(key).join(scenarios.select(key, F.lit(1).alias("s")), key, "left").join(timestamps.select(key, F.lit(1).alias("t")), key, "left")
    return marks.agg(
        F.count(F.lit(1)).alias("wavs"), F.count_if(F.col("s").isNull()).alias("no_scenario"), F.count_if(F.col("s").isNotNull() & F.col("t").isNull()).alias("no_timestamps"))


def encoded_manifest(manifest: DataFrame, encoded: DataFrame, key: str = "id") -> DataFrame:
    """Clips of the manifest that have an encoding of at least one frame."""
    return manifest.join(encoded.where("frames > 0"), key)


def encoded_counts(manifest: DataFrame, encoded: DataFrame, key: str = "id") -> DataFrame:
    """One row: clips, those without an encoding, and those whose encoding has no frames."""
    marks = manifest.select(key).join(encoded.select(key, "frames"), key, "left")
    return marks.agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("frames").isNull()).alias("missing"), F.count_if(F.col("frames") <= 0).alias("empty"))


def portable_path(path: Column, root: str) -> Column:
    """A path under root as seen from there; others as they are."""
    head = root if root.endswith("/") else root + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def render_status(exists: Column, error: Column, duration: Column) -> Column:
    """What becomes of a clip that is to be rendered: what is there is skipped, silence is an error."""
    limited = F.coalesce(error.rlike(r"(?i)\b429\b|rate.?limit|too many requests|concurrent"), F.lit(False))
    return F.when(exists, "skipped").when(limited, "rate_limited").when(error.isNotNull(), "error").when(F.coalesce(duration, F.lit(0.0)) <= 0, "error").otherwise("ok")


def deletable(raw: DataFrame, encoded: DataFrame, key: str = "id") -> DataFrame:
    """Raw files whose encoding is known to hold frames."""
    return raw.join(encoded.where("frames > 0").select(key).distinct(), key, "left_semi")


def without_scope(rows: DataFrame, **scope: str) -> DataFrame:
    """The rows that a deletion leaves: those outside the scope, a value by column; without a scope, none."""
    inside = F.lit(True)
    for column, value in scope.items():
        inside = inside & F.col(column).eqNullSafe(F.lit(value))
    return rows.where(~inside)


def voice_parts(name: Column) -> tuple[Column, Column]:
    """(gender, name) of a reference recording's file name, such as f_asha.wav; nulls if it is named otherwise."""
    pattern = r"(?i)^(female|male|f|m)_([A-Za-z0-9_-]+)\.\w+$"
    head = F.lower(F.regexp_extract(name, pattern, 1))
    return F.when(head.startswith("f"), "female").when(head.startswith("m"), "male"), F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))


def voices_by_gender(voices: DataFrame) -> DataFrame:
    """(gender, voices): the voices of each gender, in the order of place."""
    return voices.groupBy("gender").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "voice"))), lambda v: v["voice"]).alias("voices"))


def voice_totals(voices: DataFrame) -> DataFrame:
    """(gender, cloned, standard): how many voices of each kind."""
    return voices.groupBy("gender").agg(F.count_if(F.col("source") == "cloned").alias("cloned"), F.count_if(F.col("source") == "standard").alias("standard"))


def voice_of(texts: DataFrame, voices: DataFrame, key: Column) -> DataFrame:
    """Adds voice: of the voices of the row's gender, the one at the key's hash modulo their number."""
    return texts.join(F.broadcast(voices_by_gender(voices)), "gender", "left").withColumn(
        "voice", F.get("voices", md5_mod(key, F.size("voices")))).drop("voices")


def chosen_clones(wanted: DataFrame, existing: DataFrame, budget: int) -> DataFrame:
    """(hash, gender, name): of recordings not cloned yet, by content hash, as many as the budget leaves, by gender in
    proportion, the first by name."""
    from .allocation import largest_remainder

    fresh = wanted.join(existing.select("hash"), "hash", "left_anti")
    left = max(0, budget - existing.count())
    quotas = largest_remainder(fresh.groupBy("gender").agg(F.count(F.lit(1)).alias("weight")), left, "gender").select("gender", "quota")
    rank = F.row_number().over(Window.partitionBy("gender").orderBy("name", "hash"))
    return fresh.withColumn("rank", rank).join(F.broadcast(quotas), "gender").where("rank <= quota").select("hash", "gender", "name")


def default_fill(open_places: DataFrame, catalogue: DataFrame, used: DataFrame) -> DataFrame:
    """(gender, name, voice): the k-th open place of a gender, by name, gets the k-th of its default voices, in the order of
    the catalogue, that isn't used yet; places beyond those stay without."""
    nth = lambda *order: F.row_number().over(Window.partitionBy("gender").orderBy(*order))
    free = catalogue.join(used.select("gender", "voice").distinct(), ["gender", "voice"], "left_anti")
    places = open_places.select("gender", "name", nth("name", "hash").alias("k"))
    return places.join(free.select("gender", "voice", nth("place", "voice").alias("k")), ["gender", "k"], "left").select("gender", "name", "voice")


def error_summary(errors: Column, most: int = 2) -> Column:
    """The first errors of a JSON list; what is no list is cut to 100 characters."""
    listed = F.from_json(F.when(F.trim(errors).startswith("["), errors), "array<string>")
    return F.when(listed.isNotNull(), F.array_join(F.slice(listed, 1, most), "; ")).otherwise(F.substring(F.coalesce(errors, F.lit("")), 1, 100))


def range_bounds(text: Column, total: Column) -> Column:
    """(start, end) of START:END where 0 <= START < END <= total, else null."""
    start, end = (F.split_part(text, F.lit(":"), F.lit(k)).try_cast("long") for k in (1, 2))
    good = (F.size(F.split(text, ":")) == 2) & (start >= 0) & (start < end) & (end <= total)
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))


def phase_of(frames: DataFrame, flag: str = "flag") -> DataFrame:
    """One row: phase 1 if all frames are LISTEN, else 2."""
    return frames.agg(F.when(F.count_if(F.col(flag) != 0) == 0, 1).otherwise(2).alias("phase"))


def unit_summary(evals: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row: total, passed and failed, of one run or of all."""
    rows = evals if run_id is None else evals.where(F.col("run_id") == run_id)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))


def projection(spent: DataFrame, target_hours: float, price_per_hour: float, budget: float, rate: float = 1.0) -> DataFrame:
    """spent (cost_usd, hours) -> projected cost by the observed price an hour, what is left of it, and its part of the budget."""
    seen = F.col("cost_usd") + F.greatest(F.lit(0.0), target_hours - F.col("hours")) * F.col("cost_usd") / F.nullif(F.col("hours"), F.lit(0.0))
    projected = F.when(F.coalesce("hours", F.lit(0.0)) <= 0, F.lit(target_hours * price_per_hour)).otherwise(seen)
    return spent.select("cost_usd", projected.alias("projected")).select(
        "projected", F.greatest(F.lit(0.0), F.col("projected") - F.coalesce("cost_usd", F.lit(0.0))).alias("gap"), (100 * F.col("projected") * rate / budget if budget else F.lit(0.0)).alias("budget_pct"))


def progress(counts: DataFrame, least_s: float = 5.0) -> DataFrame:
    """counts (rendered, done, target, elapsed_s) -> rate a minute and minutes to go; null if nothing is left or moves."""
    rate = F.col("rendered") / (F.greatest(F.col("elapsed_s"), F.lit(least_s)) / 60)
    left = F.greatest(F.lit(0), F.col("target") - F.col("done"))
    return counts.select(rate.alias("per_minute"), F.when((rate > 0) & (left > 0), left / rate).alias("eta_min"))


def counters_by_language(clips: DataFrame) -> DataFrame:
    """(lang, hours, encoded, uploaded, deleted) and the totals under a null lang."""
    return clips.rollup("lang").agg(
        F.round(F.sum("duration_s") / 3600, 6).alias("hours"), *[F.sum(F.col(c).cast("int")).alias(c) for c in ("encoded", "uploaded", "deleted")])


def dropped_frames(frames: DataFrame, clip: str, frame: str, mask: str = "valid", share: float = 0.05, seed: str = "drop") -> DataFrame:
    """Adds kept: valid frames but for a random share, decided by clip, frame and seed, so reruns agree."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(clip), F.col(frame)).cast("binary"))
    place = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / float(1 << 20)
    return frames.withColumn("kept", F.col(mask) & (place >= share))


def proportional_trim(values: Column, own: Column, padded: Column) -> Column:
    """Of values over padded input of a batch, those of an input's own length: one at least."""
    return F.slice(values, F.lit(1), F.greatest(F.lit(1), half_even(F.size(values) * own / padded)).cast("int"))


def bucket_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """(bucket): the different second parts of paths of three parts."""
    parts = F.split(path, "/")
    return paths.where(F.size(parts) == 3).select(parts[1].alias("bucket")).distinct()


def shard_number(path: Column) -> Column:
    """The number at the end of a shard's name, or null."""
    return F.nullif(F.regexp_extract(path, r"-(\d+)\.parquet$", 1), F.lit("")).try_cast("int")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of a plan's file, or of its parts."""
    return spark.read.schema(JOB_SCHEMA).json(path)


def write_plan(plan: DataFrame, path: str, parts: int) -> None:
    """The plan, its parts by part=k, and a summary of one row."""
    from .allocation import partition_plan

    kept = partition_plan(plan, parts)
    kept.drop("part").write.mode("overwrite").json(f"{path}/plan")
    kept.repartition("part").write.mode("overwrite").partitionBy("part").json(f"{path}/parts")
    kept.agg(F.count(F.lit(1)).alias("jobs"), F.sum("count").alias("scenarios"), F.countDistinct("part").alias("parts")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(scenario_id, duration_s, words) of the .words.json files of a folder, by file name; a broken file has nulls."""
    schema = "duration_s double, words array<struct<text:string,start_s:double,end_s:double,start_char:int,end_char:int>>, _broken string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.words.json").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.words\.json$", 1)
    return rows.select(name.alias("scenario_id"), "duration_s", "words")


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all JSON-lines shards of a pattern, with the name of their file."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("shard"))


def read_keyed_lines(spark: SparkSession, path: str, fallback: DataFrame, key: str = "scenario_id") -> DataFrame:
    """(key, line): raw JSON lines by key, the last of each in the order of files and lines; keys that only the fallback
    has come from there."""
    at = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias(key), F.col("value").alias("line"), at.alias("at")).where(f"{key} is not null")
    raw = rows.groupBy(key).agg(F.max_by("line", "at").alias("line"))
    return raw.unionByName(fallback.select(key, "line").join(raw.select(key), key, "left_anti"))


def append_log(rows: DataFrame, path: str, run_id: str) -> None:
    """Appends log rows under run_id=...; a run's rows are a folder of their own."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
