"""N-gram Jaccard join by MinHash bands, verified on full n-gram sets.

Rows with equal sets of word five-grams form a set, which the join handles once, under the digest of its
n-grams. Each set has a MinHash signature, cut into bands whose number and width are chosen for a target
recall. Sets that share a band meet at a hub: the set of the band that shares most bands overall. Every
other set is verified against the hub on full five-gram sets, so the links of a large group grow with its
size, not with its square; the sets of one hub are dealt to many tasks, each of which has the hub's text
once. Links join sets to classes. The sets of each band are then compared in blocks, by one matrix product
of their shared five-grams. Out of a block come the numbers of rows that each set is similar to, each pair
counted at its first shared band, and only those links that join two classes: no list of pairs is built.
Where numbers aren't asked for, only bands that still hold several classes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, maybe_among
from .vectors import SPACED, groups_of, hashed_words, mixed, shingles

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Sets in a block, and their n-grams together, about.
BLOCK, BLOCK_GRAMS = 256, 400_000
#: Tasks that the sets of one hub are dealt to, at most.
SALTS = 256


def bands_for(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the widest bands, with as few of them as reach the recall at the similarity, of
    at most `most` hash functions together."""
    best = (most, 1)
    for rows in range(1, most + 1):
        missed, bands = 1.0, 0
        while 1 - missed < recall and (bands + 1) * rows <= most:
            bands += 1
            missed *= 1 - similarity ** rows
        if 1 - missed >= recall:
            best = (bands, rows)
    return best


def set_of(grams: np.ndarray) -> np.ndarray:
    return np.unique(grams)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for first, texts in groups_of(batch.column(2).to_pylist(), 1 << 20):
                words, offsets = hashed_words(texts, SPACED)
                grams, offsets = shingles(words, offsets, n)
                some = np.flatnonzero(np.diff(offsets) > 0)
                keys = np.zeros((len(texts), bands), np.uint64)
                if len(some):
                    for b in range(bands):
                        for r in range(rows):
                            low = np.minimum.reduceat(grams * odd[b * rows + r], offsets[some])
                            keys[some, b] = mixed(keys[some, b] + low)
                        keys[some, b] = mixed(keys[some, b] + np.uint64(b))
                names, sizes = [], np.zeros(len(texts), np.int32)
                for i in range(len(texts)):
                    own = set_of(grams[offsets[i]:offsets[i + 1]])
                    sizes[i] = len(own)
                    with np.errstate(over="ignore"):
                        names.append(np.array([own.sum(dtype=np.uint64), mixed(own).sum(dtype=np.uint64)]).tobytes() if len(own) else None)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                own = [batch.column(k).slice(first, len(texts)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.binary()), pa.array(sizes), lists], ["id", "text_hash", "name", "n", "bands"])

    return run


def grams_of(text: str | None, n: int) -> np.ndarray:
    words, offsets = hashed_words([(text or "").lower().encode("utf-8", "replace")], SPACED)
    return set_of(shingles(words, offsets, n)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _hub_links(n: int, similarity: float):
    """Rows (hub, salt, a, text), those of a hub and salt together and the hub's own (a null) first -> links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for hub, _, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = grams_of(text, n)
                if a is None:
                    known = own
                elif jaccard(own, known) >= similarity:
                    out.append((a, hub))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in range(2)], ["a", "b"])

    return run


def hub_links(met: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, hub) of met, as (a, b), whose texts' n-gram sets are similar enough; texts: (name, text).

    A hub may be met by most sets: these are salted, and the hub's text goes along once for each salt in use.
    """
    salted = met.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    own = salted.join(texts.withColumnRenamed("name", "a").hint("merge"), "a").select("hub", "salt", "a", "text")
    hubs = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("name", "hub").hint("merge"), "hub")
    rows = own.union(hubs.select("hub", "salt", F.lit(None).cast("binary").alias("a"), "text"))
    together = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("a").asc_nulls_first())
    return together.mapInArrow(_hub_links(n, similarity), "a binary, b binary")


def intersections(grams: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of at most `columns` shared n-grams at a time."""
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(grams), len(grams)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (first, first + columns))
        x = np.zeros((len(grams), columns), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += x @ x.T
    return out


def similar(grams: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs reach the Jaccard similarity, each pair once."""
    sizes = np.array([len(g) for g in grams], np.float64)
    common = intersections(grams).astype(np.float64)
    return np.triu(common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1) >= similarity, 1)


def joining_links(ids: list, classes: list, alike: np.ndarray) -> list[tuple]:
    """Similar pairs of different classes, as many as it takes to join the classes that any such pair joins."""
    numbers = {c: k for k, c in enumerate(dict.fromkeys(classes))}
    kind = np.array([numbers[c] for c in classes])
    head = {c: c for c in classes}

    def top(c):
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(alike & (kind[:, None] != kind[None, :]))):
        a, b = top(classes[i]), top(classes[j])
        if a != b:
            head[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def similar_rows(alike: np.ndarray, copies: list[int], bands: list[list[int]], at: int, parts: list[int]) -> np.ndarray:
    """For each set, the rows of the sets similar to it that the pair's block counts: sets of two parts, where
    there are two, that share no band before the one of number at."""
    counted, part = alike.copy(), np.array(parts)
    if part.min() < part.max():
        counted &= part[:, None] != part[None, :]
    keys = np.array([b[:at] for b in bands], np.int64).reshape(len(bands), at)
    i, j = np.nonzero(counted)
    for k in range(at):
        apart = keys[i, k] != keys[j, k]
        i, j = i[apart], j[apart]
    weight = np.array(copies, np.int64)
    out = np.zeros(len(copies), np.int64)
    np.add.at(out, i, weight[j])
    np.add.at(out, j, weight[i])
    return out


def _block_links(n: int, similarity: float, counted: bool):
    """Rows (band, at, i, j, own, name, class, copies, bands, text) with those of a block together -> links
    (a, b, null) and, if counted, numbers (a, null, rows similar to a)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: list[tuple] = []

        def finish() -> None:
            if len(rows) < 2:
                return
            parts, ids, classes, copies, bands, texts = map(list, zip(*rows))
            if not counted and len(set(classes)) < 2:
                return
            words, offsets = hashed_words([(t or "").lower().encode("utf-8", "replace") for t in texts], SPACED)
            grams, offsets = shingles(words, offsets, n)
            alike = similar([set_of(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], similarity)
            out.extend((*link, None) for link in joining_links(ids, classes, alike))
            if counted:
                linked = similar_rows(alike, copies, bands, key[1], parts).tolist()
                out.extend((i, None, m) for i, m in zip(ids, linked) if m)

        def collected() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["a", "b", "linked"])

        for batch in batches:
            for band, at, i, j, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if (band, at, i, j) != key:
                    finish()
                    key, rows = (band, at, i, j), []
                rows.append(row)
            yield collected()
            out = []
        finish()
        yield collected()

    return run


def block_links(rows: DataFrame, texts: DataFrame, n: int, similarity: float, counted: bool) -> DataFrame:
    """(a, b, linked) of the rows (band, at, name, n, class, copies, bands) of each band: links between those of
    different classes, and, if counted, rows with b null for the rows similar to a.

    A band's rows are dealt to blocks of about BLOCK by hashed name, and each two blocks are compared in a
    group of their own, so that no task holds a band as a whole.
    """
    most = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_GRAMS))
    sizes = rows.groupBy("band", "at").agg(F.ceil(most).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["band", "at"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    full = dealt.join(texts.hint("merge"), "name").select("band", "at", "i", "j", "own", "name", "class", "copies", "bands", "text")
    together = full.repartition("band", "at", "i", "j").sortWithinPartitions("band", "at", "i", "j", "name")
    return together.mapInArrow(_block_links(n, similarity, counted), "a binary, b binary, linked long")


def unlike_bands(placed: DataFrame) -> DataFrame:
    """(band, at) of the bands in placed (name, band, at), of those with the same sets only the first: what such
    bands hold is compared once. Sets are told by their number and two sums of hashed names."""
    own = placed.groupBy("band", "at").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64("name", F.lit("bands"))).alias("y"), F.min("name").alias("least"))
    first = F.min(F.struct("at", "band")).alias("first")
    return own.groupBy("size", "x", "y", "least").agg(first).select("first.band", "first.at")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, class): the smallest name that links (a, b) lead to, for all names in them.

    Each round takes the smallest label of all neighbours and then the label's own label, so the number
    of rounds grows with the logarithm of a class's diameter.
    """
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("name"), F.least("a", "near").alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("name", "b").hint("merge"), "b").select(F.col("a").alias("name"), "class", F.lit(None).cast("binary").alias("old"))
        every = near.unionByName(labels.withColumn("old", F.col("class")))
        lower = every.groupBy("name").agg(F.min("class").alias("class"), F.max("old").alias("old"))
        heads = labels.select(F.col("name").alias("head"), F.col("class").alias("head_class"))
        jumped = lower.join(heads.hint("merge"), lower["class"] == heads["head"]).select("name", "old", F.least("class", "head_class").alias("class"))
        previous, labels = labels, scratch.table(jumped)
        scratch.drop(previous)
        if not labels.where("class < old").limit(1).count():
            scratch.drop(both)
            return labels.select("name", "class")
        path = labels.scratch_path
        labels = labels.select("name", "class")
        labels.scratch_path = path


def jaccard_join(
    docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text",
    counted: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, linked) of the join of docs with itself.

    members (id, text_hash, name): each row with words; name is its set's digest. sets (name, copies, set_id,
    class, kept): set_id is the smallest id of the set's rows, class the smallest name of its class, kept the
    class's first row as (id, name, text_hash). linked (name, linked): the rows of other sets that are similar
    to a set's and share a band with it; empty unless counted.
    """
    bands, rows = bands_for(similarity, recall)
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "ngram-join")
    signed = scratch.table(source.mapInArrow(_signatures(n, bands, rows), "id long, text_hash long, name binary, n int, bands array<long>").where("name is not null"))
    # An id may stand for several texts: sets are known by name, and a set's text is that of its first row.
    sets = scratch.table(signed.groupBy("name").agg(
        F.min(F.struct("id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = signed.select("id", "text_hash", "name")

    placed = sets.select("name", "n", F.posexplode("bands").alias("at", "band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = scratch.table(placed.join(shared.hint("merge"), "band").select("name", "n", "at", "band", "size"))
    central = met.groupBy("name").agg(F.sum("size").alias("score"))
    live = scratch.table(met.join(central.hint("merge"), "name").select("name", "n", "at", "band", "score"))
    scratch.drop(met)
    # Texts of sets that share a band, once a set.
    first = sets.join(live.select("name").distinct(), "name", "left_semi").select("name", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    texts = scratch.table(maybe_among(source, "id", first.select("id")).join(first.hint("merge"), ["id", "text_hash"]).groupBy("name").agg(F.min("text").alias("text")))

    def alike(a: Column, b: Column) -> Column:
        """No set with so different a number of n-grams can be similar enough."""
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)

    best = F.max(F.struct("score", "name", "n")).alias("best")
    hubs = live.groupBy("band").agg(best).select("band", F.col("best.name").alias("hub"), F.col("best.n").alias("hub_n"))
    at_hub = live.join(hubs.hint("merge"), "band").where((F.col("name") != F.col("hub")) & alike(F.col("n"), F.col("hub_n")))
    to_hubs = scratch.table(hub_links(at_hub.select(F.col("name").alias("a"), "hub").distinct(), texts, n, similarity))
    known = components(to_hubs, scratch)
    scratch.drop(to_hubs)
    at = live.select("name", "n", "at", "band").join(known.hint("merge"), "name", "left").withColumn("class", F.coalesce("class", "name"))
    if counted:
        compared = unlike_bands(live)
    else:
        compared = at.groupBy("band", "at").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("band", "at")
    sides = at.join(compared.hint("merge"), ["band", "at"]).join(sets.select("name", "copies", "bands").hint("merge"), "name")
    out = scratch.table(block_links(sides, texts, n, similarity, counted))
    scratch.drop(live, texts)
    linked = out.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("linked").alias("linked"))
    between = out.where("b is not null").select("a", "b").distinct()
    if between.limit(1).count():
        # classes by the name that heads them, joined once more where a block has found a link
        top = lambda side: between.join(known.withColumnRenamed("name", side), side, "left").withColumn(side, F.coalesce("class", side)).select("a", "b")
        between = top("a")
        merged = components(top("b"), scratch)
        renamed = merged.select(F.col("name").alias("head"), F.col("class").alias("new_class"))
        every = known.union(merged.select("name", F.col("name").alias("class"))).groupBy("name").agg(F.min("class").alias("class"))
        known = every.join(renamed, every["class"] == renamed["head"], "left").select("name", F.coalesce("new_class", "class").alias("class"))
    classed = sets.select("name", "first", "copies").join(known.hint("merge"), "name", "left").withColumn("class", F.coalesce("class", "name"))
    classed = scratch.table(classed)
    kept = classed.groupBy("class").agg(F.min(F.struct(F.col("first.id").alias("id"), "name", F.col("first.text_hash").alias("text_hash"))).alias("kept"))
    ends = scratch.table(classed.join(kept.hint("merge"), "class").select("name", "copies", F.col("first.id").alias("set_id"), "class", "kept"))
    return members, ends, linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, set_id, class_id, copies, n_links), one row for each row of docs.

    class_id is the smallest id of the row's class, set_id of the rows with the same n-grams, copies
    their number; n_links counts rows: the other copies, and those of all sets whose similarity to this one
    is reached. Two rows whose similarity is reached meet if they share a band, which they do with the
    probability RECALL at the similarity itself and more surely above it; all that meet are in one class.

    Defined results: rows without words (null, empty, blank) are alone in their class, with no links;
    texts of fewer than n words have one n-gram, of all their words; texts of any length count whole; a
    null id has null ids and no links; rows that repeat an id and text count as copies. An id may stand for
    several texts, each with the class of its own text: where classes have the same smallest id, the one
    with the smallest digest has it as its class_id, and others a negative number made of their digest.
    Ties are broken by digest. An empty table gives an empty one; other columns are ignored.
    """
    members, sets, linked = jaccard_join(docs, n, similarity, RECALL, id_col, text_col)
    owners = sets.groupBy(F.col("kept.id").alias("owned")).agg(F.min("class").alias("owner"))
    facts = sets.join(owners.hint("merge"), sets["kept.id"] == owners["owned"]).join(linked.hint("merge"), "name", "left").select(
        "name", "set_id", F.when(F.col("class") == F.col("owner"), F.col("owned")).otherwise(-1 - F.xxhash64("class").bitwiseAND(F.lit((1 << 62) - 1))).alias("class_id"),
        "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    worded = members.join(facts.hint("merge"), "name").select("id", "set_id", "class_id", "copies", "n_links")
    blank = docs.where(F.col(id_col).isNull() | F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))).select(F.col(id_col).cast("long").alias("id"))
    blank = blank.select("id", F.col("id").alias("set_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return worded.union(blank).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class of docs, by id, with all columns.

    Rows without an id or without words stay. Rows are told by id and text, so a row stays or goes by its own
    text, whatever others repeat its id; rows that repeat both stay or go together.
    """
    members, sets, _ = jaccard_join(docs, id_col=id_col, text_col=text_col, counted=False)
    copy_id, copy_hash = fresh(docs.columns, "copy_id"), fresh(docs.columns, "copy_hash")
    rows = members.join(sets.select("name", "kept").hint("merge"), "name")
    stays = (F.col("id") == F.col("kept.id")) & (F.col("text_hash") == F.col("kept.text_hash")) & (F.col("name") == F.col("kept.name"))
    others = rows.where(~stays).select(F.col("id").alias(copy_id), F.col("text_hash").alias(copy_hash))
    return docs.join(others, (F.col(id_col).cast("long") == F.col(copy_id)) & (F.xxhash64(text_col) == F.col(copy_hash)), "left_anti")
