"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters and digits that stand for letters to one class each, on both sides, so
"1d1ot" meets "idiot". Terms are heads of words of SHORTEST to LONGEST letters, and shorter words as a
whole, learned from labelled rows by how much more often they occur in toxic texts; phrases that hold a
term but occur in clean texts are exceptions. A document's score is a logistic function of its summed
weights per word. The sample of labelled rows is bounded (SAMPLE_ROWS); all terms and phrases that it
supports are taken, however many.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows of each label that the lexicon is learned from, in expectation.
SAMPLE_ROWS = 4000
#: Letters of the heads of words that may be terms. Shorter words are terms as a whole only; longer words count by their head.
SHORTEST, LONGEST = 4, 16
#: Log odds from which a head of words is a term.
LEAST_ODDS = 2.0
#: Characters that are read as a letter. i, l, 1, | and ! form one class, written i.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "ա": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
#: Characters without width, and marks within a word, that are left out.
DROPPED = "­​‌‍⁠﻿"
_ASCII = str.maketrans({c: (LOOKALIKES.get(c) or (c if c.isalnum() else " ")) for c in map(chr, range(128))})


class _Fold(dict):
    """Folds one character, and remembers it."""

    def __missing__(self, code: int):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        out = "" if c in DROPPED or unicodedata.combining(c) else "".join(LOOKALIKES.get(x) or (x if x.isalnum() else " ") for x in base) or " "
        self[code] = out
        return out


_FOLD = _Fold(_ASCII)


def fold(text: str) -> str:
    """Folded words, each after a single space. A mark at a word's end (the ! in "idiot!") is no letter."""
    text = re.sub(r"[!|$@]+(?=\W|$)", " ", text.lower())
    return " " + " ".join(text.translate(_ASCII if text.isascii() else _FOLD).split())


@dataclass
class Lexicon:
    """Terms (heads of folded words) with weights, exception phrases, and the logistic function's parts."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    bias: float = -4.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(" " + term, (term, w))
        for phrase in self.exceptions:
            found.add_word(" " + phrase, (phrase, None))
        if len(found):
            found.make_automaton()
        return found


def terms_in(folded: str, automaton) -> list[tuple[str, float]]:
    """(term, weight) of every term that no exception phrase covers."""
    if not len(automaton):
        return []
    hits, spared = [], []
    for end, (term, w) in automaton.iter(folded + " "):
        if w is None:
            spared.append((end - len(term), end))
        else:
            hits.append((end - len(term), end - term.endswith(" "), term, w))
    if not spared:
        return [(h[2], h[3]) for h in hits]
    spared.sort()
    starts, furthest, top = [s for s, _ in spared], [], -1
    for _, end in spared:  # the furthest end of all phrases that start so early
        top = max(top, end)
        furthest.append(top)
    out = []
    for start, end, term, w in hits:
        k = bisect.bisect_right(starts, start)
        if not k or furthest[k - 1] < end:
            out.append((term, w))
    return out


def matches(folded: str, automaton) -> tuple[float, int]:
    """Sum of weights and number of the terms of a text."""
    found = terms_in(folded, automaton)
    return sum(w for _, w in found), len(found)


def density(weight: float, words: int) -> float:
    """Weight per ten thousand words, on a logarithmic scale."""
    return math.log1p(1e4 * weight / (words + 1))


def heads(folded: str, shortest: int = SHORTEST, longest: int = LONGEST) -> set[str]:
    """Heads of all words, of shortest to longest letters; shorter words as they are, with the space after them."""
    out = set()
    for word in set(folded.split()):
        if len(word) < shortest:
            out.add(word + " ")
        out.update(word[:n] for n in range(shortest, min(len(word), longest) + 1))
    return out


COUNTS = "head string, toxic int, n long"


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(counts.values(), pa.int64())], ["head", "toxic", "n"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t or "") for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["text", "toxic"])


def _head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            counts.update((h, toxic) for h in heads(text))
            if len(counts) > 400_000:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def log_odds(t: int, c: int, toxic: int, clean: int) -> float:
    """How much more often toxic texts hold what t of them and c clean ones hold."""
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def chosen_terms(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Of each chain of heads the one in most toxic texts, the longest of these; with its log odds."""
    found = {head: (t, log_odds(t, c, toxic, clean)) for head, t, c in rows}
    out, begun = {}, set()
    for head in sorted(found, key=lambda h: (-found[h][0], -len(h), h)):
        if head not in begun and not any(head[:k] in out for k in range(1, len(head))):
            out[head] = round(found[head][1], 6)
            begun.update(head[:k] for k in range(1, len(head) + 1))
    return out


def sums_of(counts: DataFrame, key: str) -> DataFrame:
    """(key, t, c): counts of toxic and of clean texts."""
    return counts.groupBy(key).agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """docs: (id, text); labels: (id, toxic). About sample_rows of each label are used, chosen by their
    hashed id before any text is read: the chosen labels are few enough to broadcast, and what is collected
    of them is bounded by the sample."""
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {k: min(1.0, sample_rows / max(1, n.get(k, 0))) for k in (0, 1)}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    place = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labels.where(place < share)
    found = docs.select("id", "text").join(F.broadcast(chosen), "id").select("text", "toxic")
    sample = Scratch(docs.sparkSession, "toxicity").table(found.mapInArrow(_folded, "text string, toxic int"))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    least = max(3, toxic // 500)
    counts = sums_of(sample.select("text", "toxic").mapInArrow(_head_counts, COUNTS), "head")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    # Frequent heads stay for now even if clean texts hold them too: exception phrases may account for these.
    rows = counts.where((F.col("t") >= least) & (odds >= F.when(F.col("t") >= 5 * least, 1.0).otherwise(LEAST_ODDS))).collect()
    terms = chosen_terms([(r.head, r.t, r.c) for r in rows], toxic, clean)
    lexicon = Lexicon(terms)
    lexicon.exceptions = learn_exceptions(sample, lexicon)
    held = sums_of(sample.select("text", "toxic").mapInArrow(_term_counts(lexicon), COUNTS), "head").collect()
    weights = {r["head"]: log_odds(r.t, r.c, toxic, clean) for r in held}
    lexicon.weights = {k: round(weights[k], 6) for k in terms if weights.get(k, 0) >= LEAST_ODDS}
    lexicon.exceptions = [p for p in lexicon.exceptions if any(" " + k in f" {p} " for k in lexicon.weights)]
    scored = sample.select("text", "toxic").mapInArrow(_densities(lexicon), "x double, toxic int").collect()
    # A row stands for as many as it was chosen from, so that the odds are those of all labels at any size.
    weights = np.array([1.0 / shares[r.toxic] for r in scored])
    lexicon.slope, lexicon.bias = fit_logistic(np.array([r.x for r in scored]), np.array([r.toxic for r in scored], float), weights)
    return lexicon


def _term_counts(lexicon: Lexicon):
    """Texts of each label that hold a term outside exception phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = lexicon.automaton(), Counter()
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                counts.update({(term, toxic) for term, _ in terms_in(text, automaton)})
        yield _counted(counts)

    return run


def _phrases(lexicon: Lexicon):
    """Counts of texts of each label that hold a two-word phrase around a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            counts: Counter = Counter()
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                folded, out = text + " ", set()
                for end, (term, _) in automaton.iter(folded) if len(automaton) else ():
                    start = end - len(term)
                    stop = folded.find(" ", start + 1)
                    word = folded[start + 1:stop]
                    before, after = folded[folded.rfind(" ", 0, start) + 1:start] if start else "", folded[stop + 1:max(stop + 1, folded.find(" ", stop + 1))]
                    out.update(p for p, other in ((f"{before} {word}", before), (f"{word} {after}", after)) if other)
                counts.update((p, toxic) for p in out)
            yield _counted(counts)

    return run


def learn_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around a term that two clean texts or more hold, and no toxic one."""
    found = sums_of(sample.select("text", "toxic").mapInArrow(_phrases(lexicon), COUNTS), "head")
    return sorted(r["head"] for r in found.where("t = 0 and c >= 2").collect())


def _densities(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            folded = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([density(matches(f, automaton)[0], f.count(" ")) for f in folded], pa.float64()), b.column(1)], ["x", "toxic"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, rounds: int = 200, ridge: float = 0.02) -> tuple[float, float]:
    """Newton's method with a small ridge; a row of weight w counts as w rows.

    Each step is halved until it lowers the loss enough, so that it ends at the least loss for rows that are, but for a
    few, told apart wholly: there full steps swing from one side to the other.
    """
    a = np.column_stack([x, np.ones_like(x)])
    many = np.ones_like(x) if weights is None else weights

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(many @ (np.logaddexp(0, z) - y * z) + ridge / 2 * (w @ w))

    w = np.zeros(2)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -700, 700)))
        slopes = a.T @ (many * (p - y)) + ridge * w
        step = np.linalg.solve((a * (many * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), slopes)
        gain, part = float(slopes @ step), 1.0
        if gain <= 1e-12 * (1 + now):
            break
        while part > 1e-9 and not (after := loss(w - part * step)) <= now - 1e-4 * part * gain:
            part /= 2
        if part <= 1e-9:
            break
        w, now = w - part * step, after
    return float(w[0]), float(w[1])


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x, hits = [], []
            for text in batch.column(1):
                folded = fold(text.as_py() or "")
                w, n = matches(folded, automaton)
                x.append(density(w, folded.count(" ")))
                hits.append(n)
            z = np.clip(lexicon.slope * np.array(x, float) + lexicon.bias, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z))), pa.array(hits, pa.int32())], ["id", "score", "hits"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits) for each row of docs, from the whole text.

    Defined results: null and empty texts hold no term and get the score of none; texts of any length are
    scored whole; repeated rows get equal scores; of terms that start alike the one in most toxic texts is
    kept, the longest of equal ones; without labels of both kinds the lexicon is empty and all scores are alike and low; an
    empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(lexicon), "id long, score double, hits int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for text in batch.column(at):
                folded = fold(text.as_py() or "")
                z = lexicon.slope * density(matches(folded, automaton)[0], folded.count(" ")) + lexicon.bias
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
