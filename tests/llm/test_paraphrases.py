"""Decontamination of heavy paraphrases: items of which a fifth to two fifths are changed, against brute force over all passages."""

import random
import re
from collections import Counter

from turnlake.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def leaks(docs, items):
    """(doc, item): coverage of all pairs that the whole search would report, item by item and passage by passage."""
    found = {}
    for d, text in docs:
        own = words(text)
        held = Counter(own)
        for i, item in items:
            w = words(item)
            last = words([x for x in re.split(r"[.?!:]\s+|\n", item.strip()) if x.strip(" .?!")][-1])
            if sum((held & Counter(w)).values()) < D.WITH_ANSWER * len(w):
                continue
            for at in range(0, len(own), D.HALF):
                part = own[max(0, at - len(w)):at + 2 * D.HALF + len(w)]
                if sum((Counter(part) & Counter(w)).values()) < D.WITH_ANSWER * len(w):
                    continue
                cover = subsequence(w, part) / len(w)
                if cover >= D.COVERAGE or cover >= D.WITH_ANSWER and subsequence(last, part) >= D.ANSWER * len(last):
                    found[d, i] = max(found.get((d, i), 0), cover)
    return found


def test_leaks_between_the_bars(spark):
    """Of the pairs that brute force finds with 0.6 to 0.8 of the item and its answer, at least 0.9 are found."""
    rng = random.Random(8)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    several = [b for b in bench if len(words(b[1])) >= D.HALF and len([x for x in re.split(r"[.?!:]\s+|\n", b[1].strip()) if x.strip(" .?!")]) > 1]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 400 and 4000 and lang is not null").orderBy("doc_id").collect()]
    vocabulary = [w for t in texts for w in t.split()]
    docs = []
    for k in range(240):
        _, text = rng.choice(several)
        head, answer = text.split(), len(re.split(r"[.?!:]\s+|\n", text.strip())[-1].split())
        for at in rng.sample(range(len(head) - answer), min(len(head) - answer, round(rng.uniform(0.2, 0.38) * len(head)))):
            head[at] = rng.choice(["", rng.choice(vocabulary), f"{rng.choice(vocabulary)} {head[at]}", rng.choice(vocabulary)])
        around = rng.choice(texts).split()
        cut = rng.randrange(len(around))
        docs.append((k, " ".join([*around[:cut], *head, *around[cut:]])))
    want = leaks(docs, several)
    hard = {k for k, cover in want.items() if cover < D.COVERAGE}
    frame = spark.createDataFrame([*docs, *((1000 + k, t) for k, t in enumerate(texts))], "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id): r for r in D.find_leaks(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    print("hard", len(hard), "found", len(hard & found.keys()), "all", len(want), len(want.keys() & found.keys()))
    assert len(hard) >= 60
    assert len(hard & found.keys()) >= 0.9 * len(hard) and len(want.keys() & found.keys()) >= 0.9 * len(want)
    assert all(k in want for k in found if k[0] < 1000 and k[1] in dict(several))
