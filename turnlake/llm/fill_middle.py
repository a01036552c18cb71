"""Fill-in-the-middle transformation of documents, in Spark's own expressions.

A text is cut into units (runs of ASCII letters, else single characters). Two cuts that the id's SHA-256 decides part
the units into prefix, middle and suffix, which are arranged behind sentinels so that the middle comes last. The text
is restored from the arrangement by its sentinels alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: What a text is cut into.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Sentinels before prefix, suffix and middle. None occurs within two others put together, and texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: str, n: int = 4) -> list[Column]:
    """n numbers under 2^32 that only the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def part(units: Column, start: Column, stop: Column) -> Column:
    """The text of units start (from 0) to stop (not included)."""
    return F.array_join(F.slice(units, start + 1, stop - start), "")


def restored(output: Column, form: Column) -> Column:
    """The text, from what fill_in_middle made of it: the parts behind the sentinels in their first order."""
    body = F.substring(output, len(PREFIX) + 1, (1 << 31) - 1)
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20,
) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars and output to the rows of docs.

    A text whose third draw modulo 100 is plain_from or more stays plain; of the others those whose fourth is under
    spm_below get the suffix first. No row is moved: each is made from its own id and text.

    Defined results: null and empty texts have no units, are plain and give an empty output; texts that hold a sentinel
    are plain; a null id draws as an empty one; rows that repeat an id are cut by the same draws; prefix, middle or
    suffix may be empty, where cuts meet or fall on an end; texts of any length are taken whole; an empty table gives an
    empty one. Columns of docs that are called as the added ones are replaced, other columns are kept.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    name = fresh([*docs.columns, *added], "fim")
    own = F.col(name)

    def more(df: DataFrame, **columns: Column) -> DataFrame:
        """Puts columns into the struct; each step is a projection, so that none is worked out twice."""
        have = [own[c].alias(c) for c in df.schema[name].dataType.names] if name in df.columns else []
        return df.withColumn(name, F.struct(*have, *[c.alias(k) for k, c in columns.items()]))

    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = more(docs, text=text, units=F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), h1=h1, h2=h2, h3=h3, h4=h4)
    n = F.size(own["units"])
    a, b = ((own[h] % (n + 1)).cast("int") for h in ("h1", "h2"))
    held = [F.contains(own["text"], F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (own["text"] == "") | held[0] | held[1] | held[2] | (own["h3"] % 100 >= plain_from)
    rows = more(rows, n=n, start=F.least(a, b), stop=F.greatest(a, b), form=F.when(plain, "plain").when(own["h4"] % 100 < spm_below, "spm").otherwise("psm"))
    rows = more(rows, **{k: F.when(own["form"] != "plain", part(own["units"], x, y)) for k, x, y in (
        ("prefix", F.lit(0), own["start"]), ("middle", own["start"], own["stop"]), ("suffix", own["stop"], own["n"]))})
    psm = F.concat(F.lit(PREFIX), own["prefix"], F.lit(SUFFIX), own["suffix"], F.lit(MIDDLE), own["middle"])
    spm = F.concat(F.lit(SUFFIX), own["suffix"], F.lit(PREFIX), own["prefix"], F.lit(MIDDLE), own["middle"])
    return rows.select(
        *[c for c in docs.columns if c not in added], own["n"].cast("long").alias("n"), own["form"].alias("form"),
        F.length(own["prefix"]).cast("long").alias("prefix_chars"), F.length(own["middle"]).cast("long").alias("middle_chars"),
        F.when(own["form"] == "psm", psm).when(own["form"] == "spm", spm).otherwise(own["text"]).alias("output"))
