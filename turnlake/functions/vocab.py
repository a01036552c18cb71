"""Fixed vocabularies; an id is a position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ["LISTEN", "HOLD", "INCOMPLETE", "TURN_END", "BARGE_SOFT", "BARGE_HARD", "CONTINUE", "PREFETCH_LLM", "COMMIT_LLM", "CANCEL_LLM", "SILENCE_BREAK"]
STATES = ["IDLE", "LLM_GEN", "TTS_SPEAKING", "TTS_DONE"]
BEHAVIOURS = [
    "barge_real", "barge_lookalike", "backchannel", "overlap_comp", "overlap_coop", "endpoint_end", "endpoint_hold", "correction",
    "incomplete_thinking", "silence_break", "prefetch", "nonspeech_neg",
]
LANGUAGES = ["hi", "en", "gu", "hi_en_native", "gu_en_native"]
DOMAINS = ["bfsi_collections", "support", "sales"]
PROSODIES = ["falling", "rising", "held", "flat", "distressed", "neutral"]
GENDERS = ["female", "male"]
#: Words of each length band, with 20 % headroom.
WORD_LIMITS = {"short": 30, "extended": 29, "long": 66}
#: Frames before and after that a point event is widened by.
WIDTHS = {"TURN_END": (2, 3), "BARGE_SOFT": (2, 3), "BARGE_HARD": (2, 3), "PREFETCH_LLM": (1, 6), "COMMIT_LLM": (1, 2), "CANCEL_LLM": (1, 2), "SILENCE_BREAK": (2, 4)}
#: Which event wins a frame, first to last.
PAINT_ORDER = ["BARGE_HARD", "BARGE_SOFT", "TURN_END", "COMMIT_LLM", "CANCEL_LLM", "SILENCE_BREAK", "PREFETCH_LLM"]
#: The flag that a behaviour's audio is aligned by.
PRIMARY = {
    "barge_real": "BARGE_HARD", "barge_lookalike": "CONTINUE", "backchannel": "LISTEN", "overlap_comp": "BARGE_SOFT", "overlap_coop": "CONTINUE",
    "endpoint_end": "TURN_END", "endpoint_hold": "INCOMPLETE", "correction": "TURN_END", "incomplete_thinking": "INCOMPLETE",
    "silence_break": "SILENCE_BREAK", "prefetch": "PREFETCH_LLM", "nonspeech_neg": "LISTEN",
}
SUSTAINED = ["LISTEN", "HOLD", "INCOMPLETE", "CONTINUE"]
FRAME_MS, FRAMES_PER_SECOND, WORDS_PER_SECOND = 80, 12.5, 2.2


def id_of(names: list[str], name: Column) -> Column:
    """Position of name in names; null if it is no member."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, at - 1).cast("int")


def name_of(names: list[str], position: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), (position + 1).cast("int"))


#: Marks of a training text's parts (fixed values).
MARKS = {"system": "<|sys|>", "agent": "<|agent|>", "heard": "<|stt|>", "say": "<|say|>", "said": "<|/say|>"}
