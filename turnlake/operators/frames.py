"""Frame grids: dense 80 ms labels from sparse events.

A clip's events are a short array, so its grid is built within its row by higher-order functions, run by
run: no frame is shuffled. Windows serve where the input already has a row a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, word_count
from ..functions.vocab import FLAGS, FRAMES_PER_SECOND, PAINT_ORDER, PRIMARY, STATES, SUSTAINED, WIDTHS, id_of
from . import vad

LEAST_FRAMES, TAIL_FRAMES, LOOKAHEAD = 16, 8, 25
#: State that an event leads to, whatever the state before.
LEADS_TO = {
    "BARGE_HARD": "IDLE", "CANCEL_LLM": "IDLE", "TURN_END": "LLM_GEN", "COMMIT_LLM": "LLM_GEN", "PREFETCH_LLM": "LLM_GEN",
    "SILENCE_BREAK": "TTS_SPEAKING", "BARGE_SOFT": "TTS_SPEAKING",
}


def in_order(events: Column) -> Column:
    """Events by frame; those of one frame in the order of the list."""
    return F.array_sort(events)


def with_events(scenarios: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds events, in the order of (frame_offset, ord); an empty timeline is one LISTEN at frame 0, of ord -1."""
    events = targets.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("frame_offset", "ord", "flag", "spoken_text"))).alias("events"))
    joined = scenarios.join(events, "scenario_id", "left")
    listen = F.array(F.struct(F.lit(0).alias("frame_offset"), F.lit(-1).alias("ord"), F.lit("LISTEN").alias("flag"), F.lit("").alias("spoken_text")))
    return joined.withColumn("events", F.coalesce("events", listen.cast(events.schema["events"].dataType)))


def seconds_to_frames(seconds: Column) -> Column:
    return half_even(seconds * FRAMES_PER_SECOND)


def audio_frames(words: Column) -> Column:
    """Frames of speech of so many words at the usual rate."""
    return half_even(F.greatest(F.lit(1), words) / F.lit(2.2) * F.lit(12.5))


def lengths(clips: DataFrame) -> DataFrame:
    """Adds audio_frames and num_frames: room for the audio, the last event, and a tail.

    The audio's frames are encoded_frames, else those of duration_s, where the clips have such columns; else
    they are guessed from the words.
    """
    known = [F.col(c) if c == "encoded_frames" else seconds_to_frames(F.col(c)) for c in ("encoded_frames", "duration_s") if c in clips.columns]
    last = F.coalesce(F.array_max(F.transform("events", lambda e: e["frame_offset"])), F.lit(0))
    sized = clips.withColumn("audio_frames", F.coalesce(*known, audio_frames(word_count(F.col("user_text")))).cast("long"))
    return sized.withColumn("num_frames", F.greatest(F.lit(LEAST_FRAMES), F.col("audio_frames"), last + 1) + TAIL_FRAMES)


def base_flag() -> Column:
    return F.when(F.col("agent_state").isin("TTS_SPEAKING", "LLM_GEN"), "HOLD").otherwise("LISTEN")


def _painted(clips: DataFrame) -> DataFrame:
    """Adds _starts, the events' frames within the clip, and _runs, what each event paints: the frames up to the
    next event are its own, all of them if it is sustained, else the first; later events hide earlier ones."""
    starts = F.transform("events", lambda e: F.greatest(F.lit(0), F.least(e["frame_offset"], F.col("num_frames").cast("int") - 1)))
    out = clips.withColumn("_starts", starts)

    def run(e: Column, i: Column) -> Column:
        size = F.coalesce(F.get("_starts", i + 1), F.col("num_frames").cast("int")) - F.get("_starts", i)
        leads = F.when(size > 0, F.coalesce(*[F.when(e["flag"] == k, v) for k, v in LEADS_TO.items()]))
        return F.struct(size.alias("size"), e["flag"].alias("flag"), e["flag"].isin(SUSTAINED).alias("sustained"), leads.alias("leads"))

    return out.withColumn("_runs", F.transform("events", run))


def grid(clips: DataFrame, ids: bool = False) -> DataFrame:
    """Adds flags and states, an entry a frame, as names or as ids.

    A sustained event holds until the next event of any kind, a point event for its frame; else the base. A
    state follows the flags that are painted: it is the one that the last of them led to, at first the clip's
    own; unknown ones are IDLE.
    """
    flag_of = (lambda c: id_of(FLAGS, c)) if ids else (lambda c: c)
    state_of = (lambda c: id_of(STATES, c)) if ids else (lambda c: c)
    start = F.when(F.col("agent_state").isin(STATES), F.col("agent_state")).otherwise("IDLE")
    rows = _painted(clips).withColumns({"_base": flag_of(base_flag()), "_before": F.coalesce(F.get("_starts", F.lit(0)), F.col("num_frames").cast("int"))})
    after = F.aggregate("_runs", F.array(start), lambda seen, r: F.concat(seen, F.array(F.coalesce(r["leads"], F.element_at(seen, -1)))))
    rows = rows.withColumn("_after", F.transform(after, state_of))

    def painted(r: Column) -> Column:
        flag = flag_of(r["flag"])
        rest = F.when(r["size"] > 0, F.concat(F.array(flag), F.array_repeat(F.col("_base"), r["size"] - 1))).otherwise(F.array_repeat(flag, F.lit(0)))
        return F.when(r["sustained"], F.array_repeat(flag, r["size"])).otherwise(rest)

    flags = F.concat(F.array_repeat("_base", F.col("_before")), F.flatten(F.transform("_runs", painted)))
    sizes = F.concat(F.array(F.col("_before")), F.transform("_runs", lambda r: r["size"]))
    states = F.flatten(F.zip_with("_after", sizes, lambda s, n: F.array_repeat(s, n)))
    return rows.withColumns({"flags": flags, "states": states}).drop("_starts", "_runs", "_base", "_before", "_after")


def long_grid(clips: DataFrame) -> DataFrame:
    """(scenario_id, frame, flag, state) with ids."""
    rows = grid(clips, ids=True).select("scenario_id", F.posexplode(F.arrays_zip("flags", "states")).alias("frame", "x"))
    return rows.select("scenario_id", "frame", F.col("x.flags").alias("flag"), F.col("x.states").alias("state"))


def primary_flag(behaviour: Column) -> Column:
    return F.coalesce(*[F.when(behaviour == k, v) for k, v in PRIMARY.items()])


def calibrated(clips: DataFrame, anchor: Column, primary: Column) -> DataFrame:
    """Moves events so that the first one of the list with the primary flag (else the list's last) falls on the
    anchor; none before 0. Clips without an anchor, or with an empty timeline, keep their events."""
    by_list = F.transform("events", lambda e: F.struct(e["ord"].alias("ord"), e["flag"].alias("flag"), e["frame_offset"].alias("frame_offset")))
    first = F.array_min(F.filter(by_list, lambda e: e["flag"] == primary))
    last = F.array_max(by_list)
    # a column of its own, so that it isn't worked out event by event
    clips = clips.withColumn("_by", F.when(last["ord"] >= 0, anchor - F.coalesce(first["frame_offset"], last["frame_offset"])))
    moved_by = F.col("_by")
    moved = F.transform("events", lambda e: F.struct(
        F.when(moved_by.isNull(), e["frame_offset"]).otherwise(F.greatest(F.lit(0), e["frame_offset"] + moved_by)).cast("int").alias("frame_offset"),
        e["ord"].alias("ord"), e["flag"].alias("flag"), e["spoken_text"].alias("spoken_text")))
    return clips.withColumn("events", in_order(moved)).drop("_by")


def spoken_spans(clips: DataFrame) -> DataFrame:
    """Adds spoken_spans, (frame, text) of the events that say something, and speaking_mask, 1 at their frames."""
    said = F.filter("events", lambda e: F.trim(e["spoken_text"]) != "")
    spans = F.transform(said, lambda e: F.struct(
        F.greatest(F.lit(0), F.least(e["frame_offset"], F.col("num_frames").cast("int") - 1)).alias("frame"), F.trim(e["spoken_text"]).alias("text")))
    with_spans = clips.withColumn("spoken_spans", spans)
    times = F.sequence(F.lit(0), F.col("num_frames").cast("int") - 1)
    at = F.transform("spoken_spans", lambda s: s["frame"])
    return with_spans.withColumn("speaking_mask", F.transform(times, lambda t: F.array_contains(at, t).cast("int")))


def with_track(clips: DataFrame, energy: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Adds vad, 1 where the user speaks: by the energy (key, frame, e) of the clip's first num_frames frames,
    else through the audio's frames; 0 after."""
    heard = energy.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", F.col("e").cast("double").alias("e")))).alias("_heard"))
    n = F.col("num_frames").cast("int")
    within = F.filter("_heard", lambda x: x["frame"] < F.col("num_frames"))
    track = F.when(F.size(within) > 0, vad.heard_track(F.transform(within, lambda x: x["e"])))
    guessed = F.array_repeat(F.lit(1), F.least(F.col("audio_frames"), F.col("num_frames")).cast("int"))
    return clips.join(heard, key, "left").withColumn("vad", fitted(F.coalesce(track, guessed), n, F.lit(0))).drop("_heard")


def frame_records(clips: DataFrame, energy: DataFrame, encoded_path: Column | None = None) -> DataFrame:
    """One training record a clip: lengths, flags and states as ids, the speech track, the spoken spans and their
    mask. clips have events, and audio_frames and num_frames as lengths() adds them."""
    built = with_track(spoken_spans(grid(clips, ids=True)), energy)
    path = F.lit(None).cast("string") if encoded_path is None else encoded_path
    return built.select(
        "scenario_id", "behaviour", "language", "domain", "agent_text", "user_text", F.col("num_frames").cast("int").alias("num_frames"),
        F.col("audio_frames").cast("int").alias("audio_frames"), path.alias("encoded_path"), "flags", F.col("states").alias("agent_state"), "speaking_mask", "vad", "spoken_spans")


def vap_targets(track: Column, horizon: int = LOOKAHEAD) -> Column:
    """For each frame of a track the next horizon frames, 0 beyond the end."""
    padded = F.array(F.concat(track, F.array_repeat(F.lit(0), horizon)))  # once, not frame by frame
    return F.get(F.transform(padded, lambda p: F.transform(track, lambda _, t: F.slice(p, t + 2, F.lit(horizon)))), F.lit(0))


def track_of(recorded: Column, heard: Column, length: Column) -> Column:
    """A record's speech track: its own, else the one heard from its energy, else speech throughout."""
    given = lambda x: F.when(F.size(x) > 0, x)
    return fitted(F.coalesce(given(recorded), given(heard), F.array_repeat(F.lit(1), length.cast("int"))), length, F.lit(0))


def word_spans(texts: DataFrame, key: str, text: str, seconds_a_word: float = 0.4) -> DataFrame:
    """(key, words): (text, start_s, end_s, start_char, end_char) of each word of texts with single spaces;
    end_char is inclusive."""
    parts = texts.select(key, F.posexplode(F.split(text, " ")).alias("i", "word"))
    upto = F.sum(F.length("word") + 1).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("upto", upto).select(key, F.struct(
        "i", F.col("word").alias("text"), (F.col("i") * seconds_a_word).alias("start_s"), ((F.col("i") + 1) * seconds_a_word).alias("end_s"),
        (F.col("upto") - F.length("word") - 1).alias("start_char"), (F.col("upto") - 2).alias("end_char")).alias("w"))
    return placed.groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("words"))


#: Characters that no word holds: nothing, and white space of any kind.
NO_WORDS = ["", *[chr(c) for c in range(0x3001) if chr(c).isspace()]]


def words_of_characters(characters: Column) -> Column:
    """(text, start_s, end_s, start_char, end_char) of the words in an array column of (c, start_s, end_s), one a
    character: runs without white space; end_char is inclusive."""
    def edges(step: int) -> Column:
        """Places of characters beside which, on that side, no other of the word stands."""
        return F.array_compact(F.transform(characters, lambda x, i: F.when(x["c"].isin(*NO_WORDS), None).when(F.coalesce(F.get(characters, i + step)["c"].isin(*NO_WORDS), F.lit(True)), i)))

    def word(first: Column, last: Column) -> Column:
        text = F.array_join(F.transform(F.slice(characters, first + 1, last - first + 1), lambda x: x["c"]), "")
        return F.struct(text.alias("text"), F.get(characters, first)["start_s"].alias("start_s"), F.get(characters, last)["end_s"].alias("end_s"), first.alias("start_char"), last.alias("end_char"))

    return F.zip_with(edges(-1), edges(1), word)


def character_timeline(chunks: Column) -> Column:
    """One (c, start_s, end_s) a character from chunks with the arrays characters, starts and ends; of arrays of
    different lengths in a chunk the shortest counts."""
    def of(x: Column) -> Column:
        n = F.least(F.size(x["characters"]), F.size(x["starts"]), F.size(x["ends"]))
        return F.transform(F.slice(x["characters"], F.lit(1), n), lambda c, i: F.struct(c.alias("c"), F.get(x["starts"], i).alias("start_s"), F.get(x["ends"], i).alias("end_s")))

    return F.flatten(F.transform(chunks, of))


def char_to_time(words: Column, char: Column, duration: Column | None = None, chars: Column | None = None) -> Column:
    """Seconds at a character: within the first word that holds it, in proportion; up to the first word its
    start; else the last word's end. Without words it is in proportion to the duration, if that is given."""
    hit = F.get(F.filter(words, lambda w: (w["start_char"] <= char) & (char <= w["end_char"])), F.lit(0))
    within = hit["start_s"] + (hit["end_s"] - hit["start_s"]) * (char - hit["start_char"]) / F.greatest(F.lit(1), hit["end_char"] - hit["start_char"])
    first, last = F.get(words, F.lit(0)), F.get(F.reverse(words), F.lit(0))
    timed = F.when(hit.isNotNull(), within).when(char <= first["start_char"], first["start_s"]).otherwise(last["end_s"])
    if duration is None:
        return timed
    total = F.greatest(F.lit(1), F.coalesce(F.nullif(chars, F.lit(0)) if chars is not None else F.lit(None).cast("int"), char + 1))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, timed).otherwise(duration * F.least(F.lit(1.0), char / total))


def lookahead(frames: DataFrame, clip: str, frame: str, value: str, horizon: int = LOOKAHEAD) -> DataFrame:
    """Adds ahead: the values of the next frames, 0 beyond the end."""
    w = Window.partitionBy(clip).orderBy(frame).rowsBetween(1, horizon)
    seen = F.collect_list(value).over(w)
    return frames.withColumn("ahead", F.slice(F.concat(seen, F.array_repeat(F.lit(0), horizon)), 1, horizon))


def widened(frames: DataFrame, clip: str, frame: str, flag: str, scale: float = 1.0) -> DataFrame:
    """Adds widened: point events spread by their widths; where several meet, the first in PAINT_ORDER wins.

    Reads the original flags alone, so spread events don't spread again.
    """
    out = F.col(flag)
    for name in reversed(PAINT_ORDER):
        before, after = (round(x * scale) for x in WIDTHS[name])
        near = Window.partitionBy(clip).orderBy(frame).rowsBetween(-after, before)
        out = F.when(F.max((F.col(flag) == FLAGS.index(name)).cast("int")).over(near) == 1, F.lit(FLAGS.index(name))).otherwise(out)
    return frames.withColumn("widened", out)


def filled_forward(frames: DataFrame, clip: str, frame: str, value: str) -> DataFrame:
    """Adds carried: the last value that isn't null, up to each frame."""
    w = Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def fitted(values: Column, length: Column, fill: Column) -> Column:
    """The first length values, filled up at the end."""
    return F.slice(F.concat(values, F.array_repeat(fill, length.cast("int"))), F.lit(1), length.cast("int"))


def log_pitch(values: Column) -> Column:
    """ln f0 - ln 150 where voiced, else 0."""
    return F.transform(values, lambda x: F.when(x > 1, F.log(x) - F.log(F.lit(150.0))).otherwise(0.0))


def resized(values: Column, length: int) -> Column:
    """Linear interpolation at length even places from the first to the last value."""
    n = F.size(values)
    def at(k: Column) -> Column:
        x = k * (n - 1) / F.lit(float(max(1, length - 1)))
        lo = F.floor(x).cast("int")
        a, b = F.get(values, lo), F.get(values, F.least(lo + 1, n - 1))
        return a + (b - a) * (x - lo)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)
