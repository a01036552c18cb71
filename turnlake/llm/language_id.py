"""Language identification by a bidirectional gated recurrent network over bytes.

The network runs over a text's UTF-8 bytes in both directions, its state carried along, labels every
position, and a document's probabilities are the mean over the positions that belong to letters. Texts
of more than SEGMENT bytes are read in segments, each from a state of its own. The network is trained in
numpy by backpropagation through time, on windows from a bounded sample of labelled documents. Its gates
are piecewise linear (a hard sigmoid and a hard tanh).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each language that the network is trained on, in expectation, and windows of each.
SAMPLE_DOCS, WINDOWS_PER_DOC = 600, 8
WINDOW = 48
#: Bytes that a state is carried over at most, and steps that are taken at once.
SEGMENT, STEPS = 1 << 12, 32
UNITS = 12
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII letters and of characters beyond ASCII.
LETTER_BYTES = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
GATES = ("z", "r", "n")


@dataclass
class Network:
    langs: list[str]
    parts: dict[str, np.ndarray]  # by direction and name: Ez, Er, En (256 x units), Uz, Ur, Un (units x units), W (units x langs), and b


def new_network(langs: list[str], units: int = UNITS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    parts = {"b": np.zeros(len(langs), np.float32)}
    for d in "fb":
        for g in GATES:
            parts[f"{d}E{g}"] = (rng.standard_normal((256, units)) * 0.3).astype(np.float32) + np.float32(0.5 if g != "n" else 0)
            parts[f"{d}U{g}"] = (rng.standard_normal((units, units)) * (0.4 / units ** 0.5)).astype(np.float32)
        parts[f"{d}W"] = (rng.standard_normal((units, len(langs))) * 0.3).astype(np.float32)
    return Network(langs, parts)


def sweep(parts: dict, d: str, x: np.ndarray, keep: list | None = None, h: np.ndarray | None = None) -> np.ndarray:
    """States after each position, (T, B, units); x: bytes (T, B). keep gets what the gradient needs.

    Direction b runs from the last position to the first. With a state h to start from, x is already in the
    order of the direction.
    """
    t_end, b = x.shape
    units = parts[f"{d}Uz"].shape[0]
    ez, er, en, uz, ur, un = (parts[f"{d}{k}{g}"] for k in "EU" for g in GATES)
    out = np.empty((t_end, b, units), np.float32)
    forward = d == "f" or h is not None
    h = np.zeros((b, units), np.float32) if h is None else h
    z, r, n, g = (np.empty((b, units), np.float32) for _ in range(4))
    zero, one = np.float32(0), np.float32(1)
    for t in range(t_end) if forward else range(t_end - 1, -1, -1):
        xt = x[t]
        for gate, e, u in ((z, ez, uz), (r, er, ur)):
            np.take(e, xt, 0, out=gate, mode="clip")
            np.matmul(h, u, out=g)
            np.add(gate, g, out=gate)
            np.minimum(gate, one, out=gate)
            np.maximum(gate, zero, out=gate)
        np.matmul(h, un, out=g)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), g.copy()))
        np.take(en, xt, 0, out=n, mode="clip")
        np.multiply(g, r, out=g)
        np.add(n, g, out=n)
        np.minimum(n, one, out=n)
        np.maximum(n, -one, out=n)
        if keep is not None:
            keep[-1] += (n.copy(),)
        new = out[t]
        np.subtract(h, n, out=new)
        np.multiply(new, z, out=new)
        np.add(new, n, out=new)
        h = new
    return out


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(T, B, langs): the label of every position."""
    p = net.parts
    logits = sweep(p, "f", x) @ p["fW"]
    logits += sweep(p, "b", x) @ p["bW"]
    logits += p["b"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of the mean cross-entropy over positions; x: (T, B), y: (B,), weight: (T, B)."""
    p, keeps = net.parts, {"f": [], "b": []}
    hs = {d: sweep(p, d, x, keeps[d]) for d in "fb"}
    logits = hs["f"] @ p["fW"] + hs["b"] @ p["bW"] + p["b"]
    logits -= logits.max(-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(-1, keepdims=True)
    total = max(1.0, float(weight.sum()))
    own = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(own + 1e-9) * weight).sum() / total)
    dl = prob
    np.put_along_axis(dl, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (own - 1)[..., None], 2)
    dl *= (weight / total)[..., None].astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["b"] = dl.sum((0, 1))
    for d in "fb":
        units = p[f"{d}W"].shape[0]
        grads[f"{d}W"] = hs[d].reshape(-1, units).T @ dl.reshape(-1, dl.shape[-1])
        dh_all = dl @ p[f"{d}W"].T
        dh = np.zeros(x.shape[1:] + (units,), np.float32)
        times = range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1)
        for t, (h, z, r, g, n) in reversed(list(zip(times, keeps[d]))):
            dh = dh + dh_all[t]
            dz = dh * (h - n) * ((z > 0) & (z < 1))
            dn = dh * (1 - z) * (np.abs(n) < 1)
            dr = dn * g * ((r > 0) & (r < 1))
            dg = dn * r
            dh = dh * z + dg @ p[f"{d}Un"].T + dz @ p[f"{d}Uz"].T + dr @ p[f"{d}Ur"].T
            for name, v in (("z", dz), ("r", dr), ("n", dn)):
                np.add.at(grads[f"{d}E{name}"], x[t], v)
            for name, v in (("z", dz), ("r", dr), ("n", dg)):
                grads[f"{d}U{name}"] += h.T @ v
    return loss, grads


def train(net: Network, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 11) -> float:
    """Adam over windows x (n, T) with labels y; every language is drawn equally often. The last losses' mean."""
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(net.langs))]
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    s = {k: np.zeros_like(v) for k, v in net.parts.items()}
    losses = []
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by if len(b)])
        xb = np.ascontiguousarray(x[at].T).astype(np.intp)
        loss, grads = gradients(net, xb, y[at], LETTER_BYTES[xb].astype(np.float32))
        losses.append(loss)
        norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
        lr = rate * min(1.0, 4.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            net.parts[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return float(np.mean(losses[-20:]))


def segments_of(starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments of most bytes that each [start, end) is cut into."""
    count = -(-(ends - starts) // most)
    row = np.repeat(np.arange(len(starts)), count)
    first = starts[row] + most * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + most, ends[row])


def byte_probabilities(net: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """(len(data), langs): the label of every byte of the segments [start, end) of data.

    Longer segments come first, so those still going on are a head of the list; a segment's last steps
    may go beyond its end, where nothing is kept.
    """
    p = net.parts
    out = np.empty((len(data), len(net.langs)), np.float32)
    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    lengths = ends - starts
    step, wide = np.arange(steps)[:, None], data.astype(np.intp)
    for d in "fb":
        h = np.zeros((len(starts), p[f"{d}Uz"].shape[0]), np.float32)
        for at in range(0, int(lengths[0]) if len(lengths) else 0, steps):
            m = int(np.searchsorted(-lengths, -at))  # segments longer than this
            place = starts[:m] + at + step if d == "f" else ends[:m] - 1 - at - step
            full = int(np.searchsorted(-lengths, -(at + steps - 1)))  # segments that hold all of these steps
            if full < m:
                np.clip(place, 0, len(data) - 1, out=place)
            states = sweep(p, d, wide[place], h=h[:m])
            h = states[-1]
            logits = (states.reshape(-1, states.shape[-1]) @ p[f"{d}W"]).reshape(steps, m, -1)
            parts = [(place[:, :full].ravel(), logits[:, :full].reshape(-1, logits.shape[-1]))]
            if full < m:
                inside = at + step < lengths[full:m]
                parts.append((place[:, full:][inside], logits[:, full:][inside]))
            for where, values in parts:
                if d == "f":
                    out[where] = values + p["b"]
                else:
                    out[where] += values
    out -= out.max(-1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(-1, keepdims=True)
    return out


def training_windows(text: str, doc_id: int, per_doc: int = WINDOWS_PER_DOC) -> np.ndarray:
    """Windows (n, WINDOW) at random places of a text; the id decides where."""
    b = np.frombuffer(text.encode(), np.uint8)
    rng = np.random.default_rng(abs(int(doc_id)))
    places = rng.integers(0, max(1, len(b) - WINDOW + 1), min(per_doc, 1 + len(b) // WINDOW))
    out = np.zeros((len(places), WINDOW), np.uint8)
    for row, at in zip(out, places):
        w = b[at:at + WINDOW]
        row[:len(w)] = w
    return out


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, langs = (c.to_pylist() for c in batch.columns)
        out = [(i, w.tobytes(), k) for i, t, k in zip(ids, texts, langs) for w in training_windows(t, i or 0)]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], kind) for n, kind in enumerate((pa.int64(), pa.binary(), pa.string()))], ["id", "window", "lang"])


def learn_network(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = 240) -> Network:
    """labelled: (id, text, lang). The sample is about sample_docs documents a language at most, chosen by
    hashed id, and WINDOWS_PER_DOC windows of each; only these windows reach the driver."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return new_network(["und"])
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, sample_docs / n)) for k, n in counts.items()])
    sample = labelled.where(place < share).select("id", "text", "lang").mapInArrow(_cut_windows, "id long, window binary, lang string")
    rows = sorted((r.id is None, r.id or 0, bytes(r.window), r.lang) for r in sample.collect())
    net = new_network(langs)
    if rows:
        x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
        train(net, x, np.array([langs.index(r[3]) for r in rows]), steps)
    return net


def _predict(net: Network, segment: int, block: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(net.langs)
        names = np.array([*net.langs, "und"], dtype=object)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).to_pylist()
            raw = [t.encode("utf-8", "replace") if t is not None else b"" for t in texts]
            ends = np.cumsum([len(b) for b in raw], dtype=np.int64)
            starts = ends - np.fromiter(map(len, raw), np.int64, len(raw))
            data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
            first, last = segments_of(starts, ends, segment)
            sums, weights = np.zeros((len(raw), k)), np.zeros(len(raw))
            lo = 0
            while lo < len(first):  # some segments at a time, together about a block
                hi = max(lo + 1, int(np.searchsorted(last, first[lo] + block, "right")))
                a, b = int(first[lo]), int(last[hi - 1])
                letters = LETTER_BYTES[data[a:b]]
                found = byte_probabilities(net, data[a:b], first[lo:hi] - a, last[lo:hi] - a)
                found *= letters[:, None]
                begin = first[lo:hi] - a
                row = np.searchsorted(ends, first[lo:hi], "right")
                np.add.at(sums, row, np.add.reduceat(found, begin, 0, dtype=np.float64))
                np.add.at(weights, row, np.add.reduceat(letters, begin, dtype=np.int64))
                lo = hi
            mean = sums / np.maximum(weights, 1)[:, None]
            best = mean.argmax(1)
            score = mean[np.arange(len(raw)), best]
            none = np.array([t is None or not LETTER.search(t) for t in texts], bool)
            best[none], score[none] = k, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(id, lang_pred, score) for each row of docs, from the whole text.

    Defined results: null texts and texts without a letter are `und` with score 0; texts of any length are
    read whole, in segments; repeated rows get equal predictions; of equally probable languages the first by
    name is taken; without labelled rows all others are `und` too; an empty table gives an empty
    one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(net, segment), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
