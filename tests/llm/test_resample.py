"""Resampling against plain Python, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from seqlake.llm import resample
from seqlake.llm.common import ranked


def features(text, orders=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, target, percent=25, least=20, seed=7, orders=2):
    made = [(i, *features(t, orders)) for i, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x, orders)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000))))
    rows = []
    for i, words, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    allowed = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(allowed[: percent * len(allowed) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_against_plain_python(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(map(tuple, resample.op13_resample(spark, small).collect()), key=str) == by_hand(docs, target)


def test_odd_rows(spark):
    long = "İK ſ é 😀😀 " * 3000
    docs = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x " * 30), (4, "  ... "), (5, long), (6, "A a" + " " * 20_000 + "b_B\x00c"), (7, "y " * 25), (8, "y " * 25), (9, "word"), (None, None)]
    target = ["a b", None, "", "y y y"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, b1 int, gain int")
    goal = spark.createDataFrame([(t, 5) for t in target], "text string, bucket int")
    for parameters in ({}, {"percent": 100, "least_words": 1, "orders": 3, "seed": 9}, {"percent": 60, "least_words": 0, "orders": 1}):
        got = sorted(map(tuple, resample.resampled(frame, goal, **parameters).collect()), key=str)
        want = by_hand(docs, target, **{{"least_words": "least"}.get(k, k): v for k, v in parameters.items()})
        assert [x[:4] for x in got] == [x[:4] for x in want]  # rows that share an id may change places
        assert sorted(x[4] or 0 for x in got) == sorted(x[4] or 0 for x in want)
    assert resample.resampled(frame.limit(0), goal).collect() == []
    alone = resample.resampled(frame, goal.limit(0)).collect()
    assert len(alone) == len(docs)


def test_places_over_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 5000 AS v").repartition(7)
    got = {r.id: r.place for r in ranked(df, [F.col("v").desc(), F.col("id").asc()], "place").collect()}
    assert got == {i: 5000 - i * 7919 % 5000 for i in range(5000)}
    assert ranked(df.limit(0), [F.col("v").asc()], "place").collect() == []
