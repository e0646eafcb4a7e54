"""Mixing, license scans and fingerprints against plain Python, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqlake.llm import fingerprint, licenses, mixing


# mixing


def mixed_by_hand(rows, entropy=mixing.ENTROPY, most=mixing.MOST, budget=None, seed=1):
    """Counter of (doc, source): how often each is read."""
    size = [len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for _, _, t in rows]
    tokens = Counter()
    docs = Counter()
    for (_, s, _), n in zip(rows, size, strict=True):
        tokens[s] += n
        docs[s] += 1
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())
    budget = total if budget is None else budget
    share = {s: n / total for s, n in live.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def bisect(ok):
        lo, hi = 0.0, 1.0
        if ok(lo):
            return lo
        for _ in range(mixing.HALVINGS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    h = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    a = max(bisect(lambda a: h(a) < entropy * math.log(len(live)) - 1e-12), bisect(lambda a: max(w * budget / live[s] for s, w in weights(a).items()) <= most)) if len(live) > 1 else 1.0
    md5 = lambda *p: hashlib.md5("/".join("\x01" if x is None else str(x) for x in p).encode()).hexdigest()
    out = Counter()
    for s, w in weights(a).items():
        b = math.floor(w * budget)
        full, rest = divmod(b, live[s])
        mine = [(d, n) for (d, x, _), n in zip(rows, size, strict=True) if x == s]
        for d, _ in mine:
            out[d, s] += full
        if rest:
            block = lambda d: int(md5(seed, s, d)[:8], 16) % (docs[s] // mixing.BLOCK + 1)
            key = lambda d: (md5(seed, s, full + 1, block(d)), md5(seed, s, full + 1, d))
            by = defaultdict(int)
            for d, n in mine:
                by[key(d)] += n
            run = 0
            for k in sorted(by):
                run += by[k]
                if run > rest:
                    break
                for d, _ in mine:
                    out[d, s] += key(d) == k
    return +out


def test_mixing_against_plain_python(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows += [(10_000 + i, "big", "w " * (50 + i % 7)) for i in range(300)] + [(7, None, "a b"), (8, None, None), (9, "empty", ""), (9, "empty", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for targets in ({}, {"entropy": 0.9, "most": 2.0}, {"budget": 2_000_000, "most": 1000.0}):
        got = Counter((r.doc_id, r.source) for r in mixing.mixed(df, **{("target_entropy" if k == "entropy" else k): v for k, v in targets.items()}).collect())
        assert got == mixed_by_hand(rows, **targets)


def test_mixing_meets_its_targets(spark):
    df = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    w = {r.source: r for r in mixing.weights(df, target_entropy=0.8, most=1e9).collect()}
    h = -sum(r.weight * math.log(r.weight) for r in w.values())
    assert abs(h - 0.8 * math.log(3)) < 1e-6 and sum(r.weight for r in w.values()) == pytest.approx(1)
    w = mixing.weights(df, target_entropy=1.0, most=3.0).collect()
    assert max(r.weight * 1000 / r.tokens for r in w) == pytest.approx(3, abs=1e-6)


def test_a_limit_that_no_weights_keep_is_an_error(spark):
    df = spark.createDataFrame([("a", 7), ("b", 4)], "source string, tokens long")
    with pytest.raises(ValueError, match="more than 4"):
        mixing.weights(df, most=4.0, budget=200)
    assert max(r.budget / r.tokens for r in mixing.weights(df, most=4.0, budget=44).collect()) <= 4


def test_mixing_ties_and_long_texts(spark):
    """Sources of equal tokens get equal weights; one long text beside many short ones; rows that repeat share their place."""
    rows = [(i, s, "x y") for s in "ab" for i in range(50)] + [(1000, "c", "long " * 60_000)] + [(7, "d", "t " * 9)] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed(df).collect()
    weight = {r.source: r.mix_weight for r in out}
    assert weight["a"] == weight["b"] and Counter((r.doc_id, r.source) for r in out) == mixed_by_hand(rows)


def test_mixing_edges(spark):
    schema = "doc_id long, source string, text string, mix_pass string, weight int"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a", "x y", "p", 1), (1, "a", "x y", "p", 1), (None, "a", "z", "p", 1)], schema)
    out = mixing.mixed(one).collect()
    assert len(out) == 3 and {r.mix_pass for r in out} == {1} and "weight" in out[0]
    assert mixing.mixed(spark.createDataFrame([(1, "a", None, "p", 1)], schema)).count() == 0


# license scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned_by_hand(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    joined = "".join(f" {x} " for x in w)
    base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for n, (label, pattern, priority, keywords) in enumerate(licenses.rules()):
        for m in re.finditer(pattern, joined):
            assert set(m.group().split()) & set(keywords), (pattern, m.group())
            found.append((joined[: m.start()].count(" ") // 2, m.group().count(" ") // 2, priority, n, label))
    left = [d for d in found if not any(e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] > d[1] or e[1] == d[1] and e[3] < d[3])) for e in found)]
    labels = sorted({x for _, x in base} | {d[4] for d in left})
    places = [i for i, _ in base]
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), max((d[2] for d in left), default=0) / 5, len(left))


def test_licenses_against_plain_python(spark, small):
    assert len(licenses.rules()) > 400 and len(licenses.NAMES) + len(licenses.CLAUSES) > 200
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += list(enumerate([
        "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)", "MIT license MIT License mit-license", "under CC BY-NC-SA 4.0 and CC BY 4.0 or GPLv3", "gnu GENERAL public license",
        "Copyright (c) 2020 X. All rights reserved. Released under the MIT License.", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "", None, "!!!", "ümit license", "the text is in the public domain",
        "GPLv3 see gpl-3.0 Apache-2.0 BSD-3-Clause", "\u212aEYWORD licens\u0130 licensed under the GNU GPL", "GPLv2+ or MPL-2.0; CC-BY-SA-4.0, LGPLv2.1 " * 40, "MIT license " * 3000,
        "Released under the terms of the Mozilla Public License v2.0 and the BSD 3-Clause License", "words " * 30000 + "mit license " * 50, "CC BY", "governed by the Eclipse Public License 2.0",
    ], 100_000))
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, labels string, score double")
    out = licenses.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections"))
    again = out.unionByName(out)  # rows that repeat
    assert again.count() == 2 * len(rows)
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    for i, t in rows:
        assert got[i] == scanned_by_hand(t), (i, t and t[:80])
    assert licenses.scan(df.limit(0)).count() == 0


# fingerprints


def vectors_by_hand(text):
    for sign in ".!?":
        text = text.replace(sign + " ", sign + "\n")
    for p in (x.strip(" ") for x in text.split("\n")):
        if p:
            d = hashlib.sha256(p.encode()).hexdigest()
            yield [int(d[8 * i : 8 * i + 8], 16) for i in range(8)]


def print_by_hand(text):
    lanes, slots = [0] * 8, Counter()
    for v in vectors_by_hand(text):
        lanes = [(a + b) % 2**32 for a, b in zip(lanes, v, strict=True)]
        slots[v[7] % 256] += v[7] // 256 % 2 * 2 - 1
    return lanes, sorted((k, x) for k, x in slots.items() if x)


def text_by_hand(p):
    return "".join(f"{x:08x}" for x in p[0]) + ":" + "".join(f"{k:02x}{v % 2**32:08x}" for k, v in p[1])


def likeness_by_hand(p, q):
    if p[0] == q[0]:
        return 1.0
    other = dict(q[1])
    dot = sum(v * other.get(k, 0) for k, v in p[1])
    size = math.sqrt(sum(v * v for _, v in p[1])) * math.sqrt(sum(v * v for _, v in q[1]))
    return min(1.0, max(0.0, dot / size)) if size else 0.0


def in_order(docs):
    """By descending id; null ids last, by the start of their text's MD5."""
    return sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -r[0] if r[0] is not None else -int(hashlib.md5(r[1].encode()).hexdigest()[:5], 16), r[1]))


def test_fingerprints_against_plain_python(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000, None), (5001, ""), (900_000, "a. b. c"), (900_001, "c. a. b"), (-70, "é " * 9), (10**15, "x\n" * 20000), (-(2**63), "low"), (2**63 - 1, "high. low"), (2**40, "mid")]
    docs += [(7 * 10**12 * k, f"text {k}. {k % 3}") for k in range(1, 300)] + [(None, f"none {k}. more") for k in range(30)]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in fingerprint.op5_fingerprint(spark, str(tmp_path)).collect():
        got[r.doc_id, r.fingerprint].append(r)
    order = in_order(docs)
    assert sum(map(len, got.values())) == len(docs)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        p, e = print_by_hand(t), print_by_hand(edited)
        (r,) = got[i, text_by_hand(p)]
        assert (r.n_chars, r.edited_sha256, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_by_hand(e))
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness_by_hand(p, e)), pytest.approx(likeness_by_hand(p, print_by_hand(following))))


@pytest.mark.parametrize("n", [10, 40, 100, 400, 2000, 10_000])
def test_likeness_does_not_depend_on_length(spark, tmp_path, n):
    """Texts of n paragraphs of equal length, so that the edited text keeps half of them; the next document has others."""
    text = lambda name: "\n".join(f"{name}{k:07d}" for k in range(n))
    spark.createDataFrame([(i, text(c)) for i, c in enumerate("abcdef")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = fingerprint.op5_fingerprint(spark, str(tmp_path)).collect()
    assert all(abs(r.near_edited - 0.5) < 0.25 and r.near_next < 0.25 for r in rows)
    assert abs(sum(r.near_edited for r in rows) / 6 - 0.5) < 0.1


def test_fingerprint_is_a_sum(spark):
    texts = {"a": "one\ntwo\nthree", "b": "three\none\ntwo", "c": "one\nthree", "d": "two"}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r.name: r.print for r in fingerprint.prints(df, ["name"]).collect()}
    assert got["a"] == got["b"] != got["c"]
    both = spark.createDataFrame([("x", texts["c"]), ("x", texts["d"])], df.schema)  # a text that comes in parts
    assert fingerprint.prints(both, ["name"]).first().print == got["a"]
    lanes = {k: F.array(*[F.lit(x) for x in v.lanes]) for k, v in got.items()}
    two = fingerprint.paragraph_vector(F.lit("two"))
    r = spark.range(1).select((fingerprint.added(lanes["c"], two) == lanes["a"]).alias("a"), (fingerprint.added(lanes["a"], two, -1) == lanes["c"]).alias("b")).first()
    assert tuple(r) == (True, True)


def test_fingerprint_edges(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op5_fingerprint(spark, f"{tmp_path}/none").count() == 0
    docs = [(1, "abcd"), (1, "abcd"), (None, "xy"), (None, None), (None, "xy")]
    spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, fingerprint int").write.parquet(f"{tmp_path}/some/documents.parquet")
    rows = fingerprint.op5_fingerprint(spark, f"{tmp_path}/some").collect()
    order = in_order(docs)
    want = []
    for k, (i, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)
    spark.createDataFrame(docs[:1], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert fingerprint.op5_fingerprint(spark, f"{tmp_path}/one").first().near_next == 1.0


# names in one word; the labels are written by hand


def test_license_names_in_one_word(spark):
    cases = [
        ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"),
        ("licensed under Creative Commons Attribution Share Alike 3.0", "cc-by-sa"),
        ("Licensed under the Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
        ("Licensed under the Creative Commons Attribution Non-Commercial 2.5", "cc-by-nc"),
        ("Licensed under the Creative Commons Attribution-NoDerivatives 4.0", "cc-by-nd"),
        ("Licensed under the Creative Commons Attribution-NoDerivs 3.0", "cc-by-nd"),
        ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("Licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd"),
        ("Licensed under the Creative Commons Attribution 4.0", "cc-by"),
        ("Released under the CreativeML OpenRAIL-M license", "openrail"),
        ("Released under the Open RAIL license", "openrail"),
        ("Licensed by the Boost Software License 1.0", "boost"),
        ("GPLv3 see gpl-3.0 Apache-2.0 BSD-3-Clause", "apache,bsd,gpl"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl"),
        ("AGPLv3", "agpl"),
        ("LGPL-2.1-or-later", "lgpl"),
        ("CC0-1.0", "cc0"),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
        ("Redistributions of source code must retain the above copyright notice, this list", "bsd"),
        ("Neither the name of the Example Project nor the names of its contributors may be used to endorse", "bsd"),
        ("The Software shall be used for Good, not Evil.", "json"),
        ("the general public and a license for driving", ""),
        ("(MIT OR Apache-2.0)", "apache,mit"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache,mit"),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache,mit"),
        ("BSD-3-Clause AND MIT", "bsd,mit"),
        ("ISC OR MIT", "isc,mit"),
        ("(GPL-2.0-only OR MIT) AND Zlib", "gpl,mit,zlib"),
        ("Zlib", "zlib"),
        ("ISC", "isc"),
        ("licensed under the BSL 1.1", "busl"),
        ("Business Source License 1.1", "busl"),
        ("BSL-1.0", "boost"),
        ("in accordance with bsl", ""),
        ("Released under the JSON License", "json"),
        ("wir gehen mit und ohne Hund, mit oder ohne", ""),
        ("mit and without", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]
