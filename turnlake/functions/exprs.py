"""Column expressions with the semantics that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def half_even(x: Column) -> Column:
    """To the nearest integer, ties to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where nothing was counted."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def md5_mod(key: Column, n: int | Column) -> Column:
    """The 128-bit MD5 of key modulo n, from two 64-bit halves; null where n is 0 or null."""
    digest = F.md5(key.cast("binary"))
    high, low = (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
    n = F.nullif((n if isinstance(n, Column) else F.lit(n)).cast("decimal(9,0)"), F.lit(0).cast("decimal(9,0)"))
    shift = F.lit(str(1 << 64)).cast("decimal(20,0)") % n
    return (((high % n).cast("decimal(9,0)") * shift.cast("decimal(9,0)") + low % n) % n).cast("int")


def blank(text: Column) -> Column:
    """Whether nothing but white space of any kind is there; null counts as blank."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def words(text: Column) -> Column:
    """What Unicode white space parts; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def letters(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))


def script_ok(text: Column, language: Column) -> Column:
    """Whether enough letters are of the language's script: Latin 0.7, Indic 0.85, mixed 0.45.

    Blank text fails; text without letters passes.
    """
    text = F.coalesce(text, F.lit(""))
    block = F.when(language.startswith("hi"), F.regexp_count(text, F.lit(r"[\p{L}&&[ऀ-ॿ]]"))).when(
        language.startswith("gu"), F.regexp_count(text, F.lit(r"[\p{L}&&[઀-૿]]"))).otherwise(F.regexp_count(text, F.lit(r"[\p{L}&&[\u0000-ɏ]]")))
    need = F.when(language == "en", 0.7).when(language.endswith("_native"), 0.45).otherwise(0.85)
    n = letters(text)
    return F.when(blank(text), False).when(n == 0, True).otherwise(block / n >= need)


def rank_floor(values: Column, p: float) -> Column:
    """The value at position min(n - 1, floor(p n)) of the sorted array; null if it is empty."""
    n = F.size(values)
    return F.try_element_at(F.array_sort(values), F.least(n, F.floor(F.lit(p) * n) + 1).cast("int"))


def clipped(text: Column, most: int) -> Column:
    """White space collapsed; cut to most characters, the last an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def llm_cost(prompt: Column, completion: Column) -> Column:
    """US dollars of a call, by tokens."""
    return (prompt * 0.108 + completion * 0.398) / 1e6


def tts_cost(chars: Column, seconds: Column) -> Column:
    """US dollars of a rendering: 0.3 tokens a character in, 30 000 an hour out."""
    return chars * 0.3 * 4.0 / 1e6 + seconds / 3600.0 * 30000.0 * 21.5 / 1e6
