"""Scenario records: lenient coercion, validation with reasons, corpus report and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import blank, half_even, rank_floor, ratio, script_ok, word_count
from ..functions.vocab import BEHAVIOURS, DOMAINS, FLAGS, GENDERS, LANGUAGES, MARKS, PROSODIES, STATES, WORD_LIMITS, WORDS_PER_SECOND

#: Values of fields that are missing or blank.
DEFAULTS = {"agent_state": "IDLE", "prosody": "neutral", "gender": "female", "length_band": "short"}


def _default(name: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(DEFAULTS.get(name, "")))


def coerced(records: DataFrame) -> DataFrame:
    """Text fields trimmed, blank ones set to their defaults, event_char to 0 where it is missing."""
    fields = ["behaviour", "language", "domain", "agent_text", "agent_state", "user_text", "prosody", "gender", "length_band"]
    out = records.withColumns({f: _default(f) for f in fields if f in records.columns})
    return out.withColumn("event_char", F.coalesce(F.try_to_number(F.col("event_char").cast("string"), F.lit("S999999999")).cast("int"), F.lit(0)))


def target_problem() -> Column:
    """What is wrong with an event, or null."""
    return F.when(~F.col("flag").isin(FLAGS), F.concat(F.lit("unknown flag "), F.col("flag"))).when(
        F.col("frame_offset") < 0, F.lit("negative offset")).when(F.col("spoken_text").rlike("[<>]"), F.lit("markup in spoken text"))


def word_limit(band: Column) -> Column:
    """Words of a length band; unknown bands count as short."""
    return F.coalesce(*[F.when(band == b, n) for b, n in WORD_LIMITS.items()], F.lit(WORD_LIMITS["short"]))


def problems(events: str | None = None) -> Column:
    """All that is wrong with a scenario, in a fixed order; events names the number of its events, if that counts."""
    band = word_limit(F.col("length_band"))
    checks = [
        (~F.col("behaviour").isin(BEHAVIOURS), "unknown behaviour"), (~F.col("language").isin(LANGUAGES), "unknown language"),
        (~F.col("domain").isin(DOMAINS), "unknown domain"), (~F.col("agent_state").isin(STATES), "unknown agent state"),
        (~F.col("prosody").isin(PROSODIES), "unknown prosody"), (~F.col("gender").isin(GENDERS), "unknown gender"),
        (blank(F.col("user_text")), "empty user text"), (word_count(F.col("user_text")) > band, "too many words"),
        (~F.col("event_char").between(0, F.length("user_text")), "event outside text"),
    ]
    if events is not None:
        checks.append((F.coalesce(F.col(events), F.lit(0)) == 0, "empty target timeline"))
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def verdicts(scenarios: DataFrame, targets: DataFrame) -> DataFrame:
    """(scenario_id, schema_ok, vocab_ok, script_ok): one row a scenario; its events are summed up first.

    schema_ok: nothing is wrong with the record or its events, and it has events. vocab_ok: all flags are known,
    no speech holds brackets, and what only looks like an interruption isn't resolved to one.
    """
    events = targets.groupBy("scenario_id").agg(
        F.coalesce(F.bool_and(target_problem().isNull()), F.lit(True)).alias("events_ok"), F.bool_or(F.col("flag").isin("BARGE_HARD", "BARGE_SOFT")).alias("has_barge"),
        F.bool_and(F.col("flag").isin(FLAGS) & ~F.col("spoken_text").rlike(r"[<>\[\]]")).alias("vocabulary"), F.count(F.lit(1)).alias("n_events"))
    lookalike = (F.col("behaviour") == "barge_lookalike") & F.coalesce("has_barge", F.lit(False))
    joined = scenarios.join(events, "scenario_id", "left")
    return joined.select(
        "scenario_id", "behaviour", "language", "gender", "user_text",
        ((F.size(problems("n_events")) == 0) & F.coalesce("events_ok", F.lit(True))).alias("schema_ok"), (F.coalesce("vocabulary", F.lit(True)) & ~lookalike).alias("vocab_ok"),
        script_ok(F.col("user_text"), F.col("language")).alias("script_ok"))


def flag_chain(flags: Column, most: int = 4) -> Column:
    """The first flags of a timeline in one text."""
    more = F.when(F.size(flags) > most, "…").otherwise("")
    return F.when(F.coalesce(F.size(flags), F.lit(0)) == 0, "—").otherwise(F.concat(F.array_join(F.slice(flags, 1, most), "→"), more))


def corpus_report(checked: DataFrame) -> DataFrame:
    """One row: pass rates and words a scenario (mean, median, rank-floor p10 and p90), in one pass.

    The percentiles need all word counts of the corpus; they come from a histogram of counts, whose size
    is the number of different counts.
    """
    counted = checked.withColumn("words", word_count(F.col("user_text")))
    rates = counted.agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in ("schema_ok", "vocab_ok", "script_ok")],
        F.round(F.avg("words"), 6).alias("words_mean"), F.percentile("words", 0.5).alias("words_median"))
    from pyspark.sql import Window

    histogram = counted.groupBy("words").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("words").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy())
    placed = histogram.select("words", upto.alias("upto"), total.alias("total"))
    marks = placed.agg(*[
        F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))), F.col("words"))).alias(name)
        for p, name in ((0.1, "words_p10"), (0.9, "words_p90"))])
    return rates.join(F.broadcast(marks))  # one row each


def median_seconds(report: DataFrame) -> DataFrame:
    """Adds median_s: about how long the median text of a corpus_report() takes to be said."""
    return report.withColumn("median_s", F.round(F.col("words_median") / F.lit(WORDS_PER_SECOND), 1))


def balance(checked: DataFrame, wanted: dict[str, float], tolerance: float = 0.02, gap: float = 0.04) -> DataFrame:
    """One row: whether each language's share is near the wanted one, and female and male counts are near."""
    n = F.count(F.lit(1))
    shares = [F.abs(ratio(F.count_if(F.col("language") == k), n) - v) <= tolerance for k, v in wanted.items()]
    languages = shares[0]
    for s in shares[1:]:
        languages = languages & s
    apart = ratio(F.abs(F.count_if(F.col("gender") == "female") - F.count_if(F.col("gender") == "male")), n)
    return checked.agg(languages.alias("languages_ok"), (apart <= gap).alias("genders_ok"), F.round(apart, 6).alias("gender_gap"))


def passes(report: DataFrame, schema: float = 0.99, vocab: float = 1.0, script: float = 0.98) -> DataFrame:
    """Adds exit_code: 0 where all rates reach their bars."""
    good = (F.col("schema_ok_rate") >= schema) & (F.col("vocab_ok_rate") >= vocab) & (F.col("script_ok_rate") >= script)
    return report.withColumn("exit_code", F.when(good, 0).otherwise(1))


def projected_seconds(words: Column) -> Column:
    return F.greatest(F.lit(1), words) / F.lit(WORDS_PER_SECOND)


def gender_of(raw: Column) -> Column:
    """female or male by the first letter, else null."""
    low = F.lower(F.trim(raw))
    return F.when(low.startswith("f"), "female").when(low.startswith("m"), "male")


def usable_clips(manifest: DataFrame, shortest: float = 1.5, longest: float = 20.0) -> DataFrame:
    """Clips of a usable length with a transcript; gender normalised."""
    kept = manifest.where(F.col("duration_s").between(shortest, longest) & ~blank(F.col("transcript")))
    return kept.withColumn("gender", gender_of(F.col("gender")))


def corruption(bytes_: Column, meta: Column, duration: Column, n_words: Column) -> Column:
    """Reasons to discard a rendered clip."""
    return F.array_compact(F.array(
        F.when(bytes_ < 200, "tiny file"), F.when(~meta, "no metadata"), F.when(meta & (duration <= 0), "no duration"),
        F.when(meta & (duration > 0) & (n_words == 0), "no words")))


def batch_status(returned: Column, valid: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "api_error").when(returned == 0, "parse_error").when(valid == 0, "all_invalid").otherwise("ok")


def transient(error: Column) -> Column:
    """Whether an error may pass by itself."""
    return F.coalesce(error.rlike(r"(?i)\b(502|503|504)\b|timed? ?out|connection reset|temporarily"), F.lit(False))


def rate_limited(error: Column) -> Column:
    return F.coalesce(error.rlike(r"(?i)\b429\b|rate.?limit|too many requests"), F.lit(False))


def json_in_prose(text: Column) -> Column:
    """The first JSON object of a text: fenced, the whole, or from the first { to the last }."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (fenced, F.trim(text), braces)])


def training_context(system: str, agent: Column, heard: Column, phase: int = 2) -> Column:
    """What a model reads: system prompt, the agent's text and what was heard of the user; in phase 1 the latter is
    what is to be said, so it isn't shown."""
    empty = F.lit("")
    shown = empty if phase == 1 else F.coalesce(heard, empty)
    return F.concat(F.lit(f"{MARKS['system']} {system}{MARKS['agent']} "), F.coalesce(agent, empty), F.lit(f"{MARKS['heard']} "), shown)


def spoken_tail(user: Column, spoken: Column, phase: int = 2) -> Column:
    """What a model is to say: the spoken texts, in phase 1 the user's own; empty if that is nothing."""
    said = F.coalesce(user, F.lit("")) if phase == 1 else F.array_join(F.filter(F.coalesce(spoken, F.array().cast("array<string>")), lambda t: t != ""), " ")
    return F.when(F.trim(said) != "", F.concat(F.lit(f"{MARKS['say']} "), said, F.lit(f" {MARKS['said']}"))).otherwise("")


def target_frames(seconds: Column) -> Column:
    return half_even(seconds * 12.5)


__all__ = [n for n in dir() if not n.startswith("_")] + ["rank_floor"]
