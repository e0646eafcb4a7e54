"""Statistics, taxonomy and sketches."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.operators import sketches, stats
from seqlake.operators.taxonomy import Taxonomy, checked_ranks, load_deleted, load_merged, load_names, load_nodes, pair_key


@pytest.mark.parametrize(("data", "q1", "median", "q3", "n50", "l50"), [
    ([], 0, 0, 0, 0, 0), ([2], 2, 2, 2, 2, 1), ([1, 2], 1, 1.5, 2, 2, 1), ([1, 2, 3], 1.5, 2, 2.5, 3, 1), ([1, 2, 3, 4], 1.5, 2.5, 3.5, 3, 2), ([2, 3, 4, 5, 6, 7, 8, 9], 3.5, 5.5, 7.5, 7, 3), ([5, 5, 5, 1], 3, 5, 5, 5, 2),
])
def test_length_stats(spark, data, q1, median, q3, n50, l50):
    df = spark.createDataFrame([(x,) for x in data] + [(None,)], "length long")
    r = stats.length_stats(df).first()
    assert (r["count"], r["sum"], r.q1, r.median, r.q3, r.n50, r.l50) == (len(data), sum(data), q1, median, q3, n50, l50)
    assert r.mean is None if not data else r.mean == pytest.approx(sum(data) / len(data))
    assert r.l50_distinct == (1 if data == [5, 5, 5, 1] else l50)


def test_percentiles_and_nx(spark):
    df = spark.createDataFrame([("a", x) for x in range(1, 11)] + [("b", 7)], "g string, length long")
    got = {r.g: r.percentile for r in stats.percentile(df, 25, by=["g"]).collect()}
    assert got == {"a": 2.5, "b": 7.0} and {r.g: r.percentile for r in stats.percentile(df, 90, by=["g"]).collect()} == {"a": 9.0, "b": 7.0}
    assert {r.g: (r.nx, r.lx) for r in stats.nx_lx(df, 90, by=["g"]).collect()} == {"a": (3, 8), "b": (7, 1)}
    for bad in (0, 101):
        with pytest.raises(ValueError, match="p must"):
            stats.percentile(df, bad)


NODES = ["1\t|\t1\t|\tno rank", "2\t|\t1\t|\tsuperkingdom", "10\t|\t2\t|\tphylum", "20\t|\t10\t|\tgenus", "21\t|\t10\t|\tgenus", "30\t|\t20\t|\tspecies", "31\t|\t21\t|\tspecies\r", "x\t|\t1\t|\tbad", "short"]
NAMES = ["2\t|\tBacteria\t|\t\t|\tscientific name\t|", "30\t|\tA b\t|\t\t|\tscientific name\t|", "30\t|\tother\t|\t\t|\tsynonym\t|", "10\t|\tPh\t|\t\t|\tscientific name\t|", "20\t|\tG\t|\t\t|\tscientific name\t|"]


@pytest.fixture(scope="module")
def tree(spark):
    lines = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
    return Taxonomy(load_nodes(lines(NODES)), load_names(lines(NAMES)), load_merged(lines(["300\t|\t30\t|"])))


def test_loading(spark, tree):
    assert tree.nodes.count() == 7 and tree.nodes.where("taxid = 31").first()["rank"] == "species"
    assert {tuple(r) for r in tree.names.collect()} == {(2, "Bacteria"), (30, "A b"), (10, "Ph"), (20, "G")}
    assert tree.max_taxid().first()[0] == 31
    assert load_deleted(spark.createDataFrame([("7\t|",), ("x",)], "value string")).count() == 1
    with pytest.raises(ValueError, match="start at 1"):
        load_nodes(tree.nodes, child=0)


def test_queries_of_a_taxonomy(spark, tree):
    ids = spark.createDataFrame([(1,), (2,), (30,), (300,), (31,), (99,)], "taxid long")
    lineage = {r.taxid: (r.lineage, r.lineage_names) for r in tree.with_lineage(ids, names=True).collect()}
    assert lineage[30] == lineage[300] == ([2, 10, 20, 30], ["Bacteria", "Ph", "G", "A b"]) and lineage[1][0] == [1] and lineage[99] == (None, None) and lineage[31][1] == ["Bacteria", "Ph", "", ""]
    assert {r.taxid: r.name for r in tree.with_name(ids).collect()} == {1: "", 2: "Bacteria", 30: "A b", 300: "A b", 31: "", 99: ""}
    assert {r.taxid: r["rank"] for r in tree.with_rank(ids).collect()} == {1: "no rank", 2: "superkingdom", 30: "species", 300: "species", 31: "species", 99: ""}
    assert {r.taxid: r.at_or_below for r in tree.at_or_below(ids, "Phylum").collect()} == {1: False, 2: False, 30: True, 300: True, 31: True, 99: False}
    assert {r.taxid: r.at_or_below for r in tree.at_or_below(ids, "nothing").collect()} == dict.fromkeys([1, 2, 30, 300, 31, 99], False)
    assert {r.taxid: (r.resolved, r.known) for r in tree.resolved(ids).collect()}[300] == (30, True)


def test_lca(spark, tree):
    want = {(30, 31): 10, (30, 20): 20, (20, 30): 20, (300, 31): 10, (30, 300): 30, (99, 30): 0, (99, 99): 99, (0, 30): 0, (2, 1): 1, (30, 30): 30}
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert {(r.a, r.b): r.lca for r in tree.lca(pairs).collect()} == want
    assert [r[0] for r in spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "a long, b long").select(pair_key(F.col("a"), F.col("b"))).collect()] == [0, 2**32 + 1, 2**32 + 2]


def test_a_deep_tree_and_a_cycle(spark):
    deep = spark.range(1, 301).select(F.col("id").alias("taxid"), F.greatest(F.col("id") - 1, F.lit(1)).cast("long").alias("parent"), F.lit("r").alias("rank"))
    assert {r.taxid: len(r.path) for r in Taxonomy(deep).lineages().collect()} == {i: max(1, i - 1) for i in range(1, 301)}
    with pytest.raises(ValueError, match="cycle"):
        Taxonomy(spark.createDataFrame([(1, 1, "r"), (5, 6, "r"), (6, 7, "r"), (7, 5, "r")], "taxid long, parent long, rank string")).lineages()
    with pytest.raises(ValueError, match="ranks"):
        checked_ranks(spark.range(300).select(F.col("id").cast("string").alias("rank")))


def test_xxhash_of_windows_against_the_library():
    xxhash = pytest.importorskip("xxhash")
    data = bytes(random.Random(2).randrange(256) for _ in range(140))
    for k in (1, 3, 4, 7, 8, 10, 15, 31, 32, 33, 47, 64, 101):
        want = [xxhash.xxh64_intdigest(data[i : i + k], seed=1) for i in range(len(data) - k + 1)]
        assert [int(x) for x in sketches.xxhash64_windows(np.frombuffer(data, np.uint8), k)] == want


SEQ = "GGCAAGTTCGTCA"


def test_sketch_goldens():
    at, h = sketches.minimizers(SEQ, 5, 3)
    assert list(at) == [0, 1, 4, 7, 8]
    assert [int(x) for x in h] == [973456138564179607, 2645801399420473919, 1099502864234245338, 6763474888237448943, 2737971715116251183]
    s = "".join(random.Random(1).choice("ACGT") for _ in range(100))
    assert len(sketches.kmer_codes(s, 10)[0]) == len(sketches.nthash(s, 10)[0]) == 91 and len(sketches.protein_kmers(s, 10)[0]) == 24
    assert len(sketches.simhash(s[:21], 21, 5, 5)[0]) == 1 and len(sketches.kmer_codes(s, 10, circular=True)[0]) == 100
    forward, both = sketches.kmer_codes("ACGTT", 3, canonical=False)
    assert list(both) == [0b000110, 0b011011, 0b101111, 0b000001, 0b000110, 0b011011] and list(forward) == [0, 1, 2, 0, 1, 2]
    for make, args in ((sketches.kmer_codes, ("AXG", 2)), (sketches.kmer_codes, ("A", 2)), (sketches.minimizers, ("ACG", 3, 5)), (sketches.syncmers, ("ACG", 3, 5)), (sketches.simhash, ("ACGTAC", 5, 3)), (sketches.protein_kmers, ("ACGT", 2))):
        with pytest.raises(ValueError):
            make(*args)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=12, max_size=80), st.integers(2, 6), st.integers(1, 6))
def test_sketches_against_plain_loops(s, k, w):
    h = [int(x) for x in sketches.nthash(s, k)[1]]
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert h == [int(x) for x in sketches.nthash(rc, k)[1]][::-1]
    if len(s) >= k + w - 1:
        want = []
        for i in range(len(h) - w + 1):
            m = min(range(i, i + w), key=lambda j: (h[j], j))
            if not want or want[-1] != m:
                want.append(m)
        assert list(sketches.minimizers(s, k, w)[0]) == want
    short = min(k, 3)
    if short < k and len(s) >= 2 * k - short - 1:
        small = [int(x) for x in sketches.nthash(s, short)[1]]
        half, starts = k - short, set()
        for i in range(len(small) - 2 * half + 1):
            m = min(range(i, i + 2 * half), key=lambda j: (small[j], j))
            starts.add(m if m < i + half else m - half)
        at, codes = sketches.syncmers(s, k, short)
        assert list(at) == sorted(x for x in starts if x < len(h)) and [int(x) for x in codes] == [h[x] for x in at]
    m, width = 4, 7
    hm = [int(x) for x in sketches.nthash(s, m)[1]]
    for scale in (1, 3):
        got = sketches.simhash(s, width, m, scale)[1]
        for i in range(len(s) - width + 1):
            kept = [x for x in hm[i : i + width - m + 1] if x and x <= (2**64 - 1) // scale]
            assert int(got[i]) == sum(1 << b for b in range(64) if kept and sum(x >> b & 1 for x in kept) >= (len(kept) + 1) // 2)


def test_sketches_of_a_table(spark):
    df = spark.createDataFrame([(1, SEQ), (2, None), (3, "AC"), (4, SEQ.lower())], "id long, seq string")
    rows = sketches.sketch(df, "minimizers", k=5, w=3).collect()
    assert sorted((r.id, r.idx) for r in rows) == [(i, x) for i in (1, 4) for x in (0, 1, 4, 7, 8)]
    with pytest.raises(Exception, match="too short"):
        sketches.sketch(df, "minimizers", skip_short=False, k=5, w=3).collect()
    native = {(r.id, r.idx, r.code) for r in sketches.kmer_codes_native(df, 4).collect()}
    assert native == {(r.id, r.idx, r.code) for r in sketches.sketch(df, "kmers", k=4).collect()}
    assert {(r.id, r.idx, r.code) for r in sketches.nthash_native(df, "id", 5).collect()} == {(r.id, r.idx, r.code) for r in sketches.sketch(df, "nthash", k=5).collect()}
    low = sketches.scaled_minhash(df, 5, 4)
    assert all(np.uint64(r.code & (2**64 - 1)) <= np.uint64((2**64 - 1) // 4) for r in low.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 70))
def test_window_minima_are_the_leftmost(values, w):
    h = np.array(values, np.uint64)
    want = [min(range(i, i + w), key=lambda j: (values[j], j)) for i in range(len(values) - w + 1)]
    assert list(sketches.window_minima(h, w)) == want


KINDS = [
    ("kmers", {"k": 5}), ("kmers", {"k": 5, "circular": True}), ("nthash", {"k": 7, "circular": True}), ("nthash", {"k": 7, "canonical": False}), ("simhash", {"k": 12, "m": 5, "scale": 3, "circular": True}), ("minimizers", {"k": 5, "w": 9}),
    ("minimizers", {"k": 5, "w": 1, "circular": True}), ("syncmers", {"k": 8, "s": 3}), ("syncmers", {"k": 8, "s": 3, "circular": True}), ("syncmers", {"k": 8, "s": 8}), ("protein_kmers", {"k": 3}), ("protein_kmers", {"k": 3, "frame": -2, "table": 2}),
    ("protein_kmers", {"k": 3, "is_protein": True}), ("protein_minimizers", {"k": 3, "w": 4, "frame": 3}), ("protein_minimizers", {"k": 3, "w": 4, "frame": -1}), ("protein_minimizers", {"k": 3, "w": 4, "is_protein": True}),
]


@pytest.mark.parametrize(("kind", "parameters"), KINDS)
def test_pieces_give_the_codes_of_the_whole(spark, kind, parameters):
    rng = random.Random(8)
    # Runs of one letter give ties across every seam.
    rows = [(i, "".join(rng.choice("ACGT") * rng.choice([1, 1, 1, 15]) for _ in range(rng.choice([3, 40, 90, 200])))) for i in range(30)] + [(98, "ACGU" * 30), (99, "ACGT" * 9 + "é" + "ACGN" * 9), (100, None), (101, "")]
    want = set()
    for i, s in rows:
        try:
            at, h = sketches.codes_of(s, sketches.SKETCHES[kind](**parameters), 1 << 40) if s is not None else ([], [])
        except ValueError:
            continue
        want |= {(i, int(a), int(x) - (1 << 64 if int(x) >> 63 else 0)) for a, x in zip(at, h, strict=True)}
        for size in (7, 64):
            again = sketches.codes_of(s, sketches.SKETCHES[kind](**parameters), size) if s is not None else ([], [])
            assert [list(x) for x in again] == [list(at), list(h)]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "id long, `a.seq` string, code string")
    for size, tasks in ((30, 3), (1 << 20, 0)):
        got = sketches.sketch(df.withColumnRenamed("code", "other"), kind, "a.seq", size=size, tasks=tasks, **parameters).collect()
        assert len(got) == len(want) and {(r.id, r.idx, r.code) for r in got} == want
        assert all(r.other == "x" for r in got)
    assert sketches.sketch(df.limit(0), kind, "a.seq", **parameters).collect() == []


def test_numbers_and_ancestors_of_random_forests(spark):
    rng = random.Random(6)
    # Stars, chains, several roots, and a node whose parent is no node.
    parent = {1: 1, 500: 500, 900: 12345}
    for i in range(2, 160):
        parent[i] = rng.choice([1, i - 1, rng.randrange(1, i), 7 if i > 7 else 1])
    for i in range(501, 560):
        parent[i] = rng.choice([500, i - 1])
    parent[901] = 900
    t = Taxonomy(spark.createDataFrame([(i, p, "genus" if i % 11 == 3 or i in (1, 500) else "r") for i, p in parent.items()], "taxid long, parent long, rank string"))

    def up(i):
        out = [i]
        while parent.get(out[-1], out[-1]) in parent and parent[out[-1]] != out[-1]:
            out.append(parent[out[-1]])
        return out

    pre = {r.taxid: r for r in t.numbered().collect()}
    assert set(pre) == set(parent) and sorted(r.pre for r in pre.values()) == list(range(2, len(parent) + 2))
    for i in parent:
        assert [j for j in parent if pre[i].pre <= pre[j].pre <= pre[i].last] == [j for j in parent if i in up(j)] and pre[i].depth == len(up(i))
    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(1500)] + [(1, 1), (0, 5), (5, 4040), (4040, 4040), (900, 901), (900, 3), (12345, 900)]
    want = {}
    for a, b in pairs:
        both = [x for x in up(a) if x in up(b)] if a in parent and b in parent else []
        want[a, b] = 0 if not a or not b else a if a == b else 0 if a not in parent or b not in parent else both[0] if both else 500
    df = spark.createDataFrame(list(want), "a long, b long")
    assert {(r.a, r.b): r.lca for r in t.lca(df).collect()} == want
    got = {(r.a, r.b): r.is_below for r in t.below(df, "a", "b").collect()}
    assert got == {(a, b): a in parent and b in up(a) for a, b in want}
    ids = spark.createDataFrame([(i,) for i in [*parent, 4040]], "taxid long")
    marked = {r.taxid: r.at_or_below for r in t.at_or_below(ids, "Genus").collect()}
    assert marked == {i: i in parent and (i in (1, 500) or any(x % 11 == 3 and parent[x] != x for x in up(i))) for i in [*parent, 4040]}
    deep = Taxonomy(spark.range(1, 3001).select(F.col("id").alias("taxid"), F.greatest(F.col("id") - 1, F.lit(1)).cast("long").alias("parent"), F.lit("r").alias("rank")))
    assert {(r.a, r.b): r.lca for r in deep.lca(spark.createDataFrame([(3000, 17), (5, 2999), (1, 3000)], "a long, b long")).collect()} == {(3000, 17): 17, (5, 2999): 5, (1, 3000): 1}
    with pytest.raises(ValueError, match="cycle"):
        Taxonomy(spark.createDataFrame([(1, 1, "r"), (5, 6, "r"), (6, 7, "r"), (7, 5, "r")], "taxid long, parent long, rank string")).numbered()
    assert Taxonomy(spark.createDataFrame([], "taxid long, parent long, rank string")).numbered().collect() == []


def test_expansions_as_rows(spark):
    from seqlake.functions.sequence import degenerate_seqs
    from seqlake.operators.expansions import degenerate_count, expanded

    df = spark.createDataFrame([(1, "ARn"), (2, ""), (3, None), (4, "A>"), (5, "NNN"), (6, "acg"), (7, "AR")], "id long, `the.seq` string")
    want = {r.id: r.s for r in df.select("id", degenerate_seqs(F.col("`the.seq`")).alias("s")).collect()}
    for size, tasks in ((7, 3), (1 << 16, 0)):
        got = {}
        for r in expanded(df, "the.seq", size, tasks).orderBy("id", "idx").collect():
            assert len(got.setdefault(r.id, [])) == r.idx
            got[r.id].append(r.seq)
        assert got == {i: s for i, s in want.items() if s is not None}
    many = spark.createDataFrame([("N" * 9,), ("N" * 40,)], "seq string")
    assert [r[0] for r in many.select(degenerate_count(F.col("seq"))).collect()] == [5**9, None]
    assert expanded(many.limit(1), tasks=4).agg(F.count("*"), F.countDistinct("seq"), F.max("idx")).first()[:] == (5**9, 5**9, 5**9 - 1)
    with pytest.raises(Exception, match="too many"):
        expanded(many).count()


def test_table_functions_of_sql(spark):
    from seqlake.operators.table_functions import register

    register(spark)
    df = spark.createDataFrame([(1, "x", SEQ), (2, "y", None), (3, "z", "AC"), (4, None, SEQ.lower())], "id long, name string, bases string")
    df.createOrReplaceTempView("reads")
    got = spark.sql("SELECT id, name, idx, code FROM minimizers(TABLE(reads), 5, w => 3, seq => 'bases')").collect()
    want = sketches.sketch(df, "minimizers", "bases", k=5, w=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 10
    assert spark.sql("SELECT * FROM kmers(TABLE(SELECT bases AS seq FROM reads), 4)").columns == ["idx", "code"]
    for bad in ("minimizers(TABLE(reads), 5, 3)", "minimizers(TABLE(reads), 0, 3, seq => 'bases')", "minimizers(5, 5, 3)"):
        with pytest.raises(Exception, match="column|must|table"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_sums_over_ranges_of_lengths(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(g, rng.choice([1, 5, 40, 41, 300, 5000, 100_000, rng.randrange(1, 3000)])) for g in ("a", "b", None) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, length long")
    want = {r.g: r for r in stats.length_stats(df, by=["g"]).collect()}
    nx = {r.g: r for r in stats.nx_lx(df, 70, by=["g"]).collect()}
    monkeypatch.setattr(stats, "RANGE", 37)
    assert {r.g: r for r in stats.length_stats(df, by=["g"]).collect()} == want and {r.g: r for r in stats.nx_lx(df, 70, by=["g"]).collect()} == nx
    assert stats.length_stats(df.groupBy("g", "length").agg(F.count("*").alias("k")), by=["g"], n="k").where("g = 'a'").first() == want["a"]


def test_statistics_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    from seqlake.streaming.ingest import running_length_stats, stream_fasta

    rng = random.Random(2)
    folder, seen, rows = tmp_path / "in", [], []
    folder.mkdir()

    def to(out, number):
        seen.append({r.kind: r for r in out.collect()})

    for trigger in range(3):
        part = [("s" if rng.random() < 0.5 else "t", rng.randrange(0, 60)) for _ in range(25)]
        rows += part
        (folder / f"{trigger}.fa").write_text("".join(f">{k}{i} x\n{'A' * n}\n" for i, (k, n) in enumerate(part)))
        records = stream_fasta(spark, str(folder)).select(F.substring("id", 1, 1).alias("kind"), F.length("seq").alias("length"))
        running_length_stats(records, to, str(tmp_path / "state"), by=["kind"], availableNow=True).awaitTermination()
        batch = stats.length_stats(spark.createDataFrame(rows, "kind string, length long"), by=["kind"]).collect()
        assert seen[-1] == {r.kind: r for r in batch}
    assert len(seen) == 3


@pytest.mark.parametrize("kind", ["nthash", "kmers"])
def test_a_sequence_is_made_once(spark, small, kind):
    """Filters on a sequence's length were pushed below it: it was made anew for each of 17 mentions."""
    from seqlake.plans.derived import sequences

    plan = sketches.sketch(sequences(spark, small).select("doc_id", "seq"), kind, k=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^ACGTacgt]") == 1


def test_batches_of_letters_are_small_and_give_the_same_codes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ACGTTGCAAC" * (i % 7 + 1)) for i in range(300)], "i long, seq string")
    got = lambda: sorted(map(tuple, sketches.sketch(rows, "simhash", k=21, m=5, scale=5).collect()))
    want = got()
    assert sketches.LETTERS <= 1 << 18
    monkeypatch.setattr(sketches, "LETTERS", 100)
    assert got() == want


def test_native_hashes_need_no_shuffle(spark):
    """Five rows of each letter were joined and shuffled."""
    long = "".join(random.Random(5).choices("ACGTacgtN", k=1500))
    rows = spark.createDataFrame([(1, long), (2, "ACGTA"), (3, "ACG"), (4, None), (5, "NNNNNNACGTNNNNNN"), (6, "éACGTA")], "i long, seq string")
    got = sketches.nthash_native(rows, "i", 5)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(r.i, x, int(c)) for r in rows.where("i < 6").collect() if r.seq and len(r.seq) >= 5 for x, c in zip(*(y.tolist() for y in (lambda t: (t[0], t[1].view(np.int64)))(sketches.nthash(r.seq, 5))), strict=True) if set(r.seq[x : x + 5].upper()) & set("ACGT")}
    out = [tuple(r) for r in got.where("i < 6").collect()]
    assert len(out) == len(set(out)) and set(out) == want
    assert got.where("i = 6").count() == 2
