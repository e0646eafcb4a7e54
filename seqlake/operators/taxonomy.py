"""Taxonomy trees as DataFrames: loading dump files, resolving ids, lineages, lowest common ancestors, ranks.

A taxonomy is nodes(taxid, parent, rank), names(taxid, name) and merged(old, new). What queries need is made once for each
Taxonomy, kept as tables in the shared folder, and joined with: a row for each node, never one for each pair of a node and
an ancestor.

numbered() walks through the tree in depth-first order without walking: the tour is a list of events (a node is entered,
a node is left), each of which knows the next one, and by pointer doubling every event learns how many come behind it in
log2(2 n) joins, however deep the tree is. A node's number and its last descendant's number bound an interval, so "lies
below" is a range test. Lowest common ancestors are found by bit arithmetic on numbers that put each node on a path of
the tree (Schieber and Vishkin, 1988): two look-ups of a pair's nodes and two of its paths' heads. Lineages, as arrays, are made by
pointer doubling on paths, for those who ask for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rounds of doubling: paths of 2**ROUNDS nodes at most.
ROUNDS = 16
#: Stands above all roots, and above nodes whose parent is no node. Ids must lie between it and its negative.
ABOVE = -(1 << 60)
#: Numbers of nodes that a task goes through at a time.
BLOCK = 1 << 16


# loading


def _columns(lines: DataFrame, places: dict[str, int], numbers: tuple[str, ...]) -> DataFrame:
    """Tab-separated columns by 1-based place. Rows that are short or whose numbers are none are left out."""
    if any(p < 1 for p in places.values()):
        raise ValueError("column numbers start at 1")
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    got = lines.withColumn("__p", parts).where(F.size("__p") >= max(places.values()))
    out = got.select(*[F.get("__p", F.lit(p - 1)).alias(c) for c, p in places.items()], *[c for c in lines.columns if c != "value"])
    for c in numbers:
        out = out.withColumn(c, F.expr(f"try_cast({c} AS BIGINT)")).where(F.col(c).isNotNull())
    return out


def load_nodes(lines: DataFrame, child: int = 1, parent: int = 3, rank: int | None = 5) -> DataFrame:
    """nodes of a dump file's lines (column value). rank: None if the file has none."""
    return _columns(lines, {"taxid": child, "parent": parent} | ({"rank": rank} if rank else {}), ("taxid", "parent"))


def load_names(lines: DataFrame, taxid: int = 1, name: int = 3, kind: int | None = 7, only: str | None = "scientific name", order: str | None = None) -> DataFrame:
    """names; with a kind column only rows of that kind. The row that is last by the column order wins; without it the
    greatest name does."""
    rows = _columns(lines, {"taxid": taxid, "name": name} | ({"kind": kind} if kind else {}), ("taxid",))
    if kind and only is not None:
        rows = rows.where(F.col("kind") == only)
    return rows.groupBy("taxid").agg(F.max_by("name", F.struct(*([order] if order else []), "name")).alias("name"))


def load_merged(lines: DataFrame, old: int = 1, new: int = 3) -> DataFrame:
    return _columns(lines, {"old": old, "new": new}, ("old", "new"))


def load_deleted(lines: DataFrame, taxid: int = 1) -> DataFrame:
    return _columns(lines, {"taxid": taxid}, ("taxid",))


def checked_ranks(nodes: DataFrame, most: int = 255) -> DataFrame:
    """The nodes, if they have so many different ranks at most; else an error."""
    if nodes.select("rank").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ranks")
    return nodes


@dataclass
class Taxonomy:
    nodes: DataFrame
    names: DataFrame | None = None
    merged: DataFrame | None = None
    _kept: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def root(self) -> Column:
        """The node that is its own parent (the greatest, if several are), as a scalar subquery."""
        return self.nodes.where("taxid = parent").agg(F.max("taxid").alias("root"))

    def max_taxid(self) -> DataFrame:
        return self.nodes.agg(F.greatest(F.max("taxid"), F.max("parent")).alias("max_taxid"))

    def lineages(self) -> DataFrame:
        """taxid, path: node ids from below the root down to the node; the root's own path is itself."""
        return self._once("lineages", self._lineages)

    def _lineages(self) -> DataFrame:
        nodes = self.nodes.select("taxid", "parent").dropDuplicates(["taxid"])
        root = nodes.where("taxid = parent").select(F.col("taxid").alias("root"))
        now = nodes.join(root, nodes["parent"] == root["root"], "left").select("taxid", "parent", F.array("taxid").alias("path"), F.col("root").isNotNull().alias("done"))
        for _ in range(ROUNDS):
            now = written(now)
            # A path that comes back to one of its nodes is a cycle.
            left = now.where("not done").agg(F.count("*").alias("n"), F.max(F.array_contains("path", F.col("parent")) & (F.col("taxid") != F.col("parent"))).alias("cycle")).first()
            if left.cycle:
                raise ValueError("the tree has a cycle")
            if not left.n:
                return now.select("taxid", "path")
            above = now.select(F.col("taxid").alias("above"), F.col("parent").alias("next"), F.col("path").alias("head"), F.col("done").alias("ends"))
            open_ = now.where("not done").join(above, F.col("parent") == F.col("above"), "left")
            # A parent that is no node ends the path.
            grown = open_.select("taxid", F.coalesce("next", "parent").alias("parent"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.coalesce("ends", F.lit(True)).alias("done"))
            now = now.where("done").unionByName(grown)
        raise ValueError("the tree is too deep")

    def numbered(self) -> DataFrame:
        """taxid, parent (null: a root, or a node whose parent is no node), pre (its number in depth-first order, children by id), last
        (the greatest number below it), depth, inlabel (the number of its path) and ascendant (bits of the paths above it).

        A cycle is an error.
        """
        return self._once("numbered", self._numbered)

    def _numbered(self) -> DataFrame:
        nodes = self.nodes.select("taxid", "parent").dropDuplicates(["taxid"])
        known = nodes.select(F.col("taxid").alias("up"))
        top = F.col("up").isNull() | (F.col("taxid") == F.col("parent"))
        tree = nodes.join(known, F.col("parent") == F.col("up"), "left").select("taxid", F.when(top, ABOVE).otherwise(F.col("parent")).cast("long").alias("parent"))
        tree = written(tree.unionByName(self.nodes.sparkSession.range(1).select(F.lit(ABOVE).cast("long").alias("taxid"), F.lit(None).cast("long").alias("parent"))))
        n = tree.count()
        # A node is entered (2 id) and left (2 id + 1). Behind a node's entry comes its first child's, or its own end; behind its end
        # its next sibling's entry, or its parent's end.
        first = tree.groupBy(F.col("parent").alias("of")).agg(F.min("taxid").alias("child"))
        siblings = tree.withColumn("next", F.lead("taxid").over(Window.partitionBy("parent").orderBy("taxid"))).join(first, F.col("taxid") == F.col("of"), "left")
        entry, end = F.col("taxid") * 2, F.col("taxid") * 2 + 1
        entered = F.struct(entry.alias("event"), F.coalesce(F.col("child") * 2, end).alias("then"), F.lit(1).cast("long").alias("entries"), F.lit(0).cast("long").alias("ends"))
        left = F.struct(end.alias("event"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("then"), F.lit(0).cast("long").alias("entries"), F.lit(1).cast("long").alias("ends"))
        now = written(siblings.select(F.inline(F.array(entered, left))))
        for _ in range((2 * n).bit_length()):
            behind = now.select(F.col("event").alias("e"), F.col("then").alias("t"), F.col("entries").alias("x"), F.col("ends").alias("y"))
            now = now.join(behind, F.col("then") == F.col("e"), "left")
            now = written(now.select("event", F.col("t").alias("then"), (F.col("entries") + F.coalesce("x", F.lit(0))).alias("entries"), (F.col("ends") + F.coalesce("y", F.lit(0))).alias("ends")))
        if now.where("then IS NOT NULL").limit(1).count():
            raise ValueError("the tree has a cycle")
        is_entry = F.pmod("event", F.lit(2)) == 0
        at = lambda c, which: F.max(F.when(which, F.col(c)))
        sums = now.groupBy(F.shiftright("event", 1).alias("id")).agg(at("entries", is_entry).alias("from_entry"), at("ends", is_entry).alias("ends"), at("entries", ~is_entry).alias("from_end"))
        pre, size = n - F.col("from_entry") + 1, F.col("from_entry") - F.col("from_end")
        placed = sums.select(F.col("id").alias("taxid"), pre.alias("pre"), (pre + size - 1).alias("last"), (F.col("ends") - F.col("from_entry")).alias("depth"))
        # The number within a node's interval that ends in the most zeros names its path; a path's nodes lie one above another.
        bit = _top_bit((F.col("pre") - 1).bitwiseXOR(F.col("last")))
        placed = placed.withColumn("inlabel", F.call_function("shiftleft", F.call_function("shiftright", F.col("last"), bit), bit))
        now = written(placed.join(tree, "taxid").withColumns({"next": F.col("parent"), "ascendant": F.col("inlabel").bitwiseAND(-F.col("inlabel"))}))
        for _ in range(int(now.agg(F.max("depth")).first()[0]).bit_length()):
            above = now.select(F.col("taxid").alias("a"), F.col("next").alias("b"), F.col("ascendant").alias("c"))
            now = now.join(above, F.col("next") == F.col("a"), "left").withColumns({"next": F.col("b"), "ascendant": F.col("ascendant").bitwiseOR(F.coalesce("c", F.lit(0)))}).drop("a", "b", "c")
            now = written(now)
        return now.where(F.col("taxid") != ABOVE).select("taxid", F.nullif("parent", F.lit(ABOVE)).alias("parent"), "pre", "last", "depth", "inlabel", "ascendant")

    def heads(self) -> DataFrame:
        """inlabel, above (the parent of the path's first node; null: there is none) and depth (the parent's)."""
        first = F.min_by(F.struct(F.col("parent").alias("above"), (F.col("depth") - 1).alias("depth")), "depth")
        return self._once("heads", lambda: written(self.numbered().groupBy("inlabel").agg(first.alias("h")).select("inlabel", "h.*")))

    def resolved(self, df: DataFrame, taxid: str = "taxid", out: str = "resolved", known: str = "known") -> DataFrame:
        """Add the id itself if it is a node, else the id it was merged into; known is false where it is neither."""
        nodes = self.nodes.select(F.col("taxid").alias("__node")).distinct()
        rows = df.join(nodes, df[taxid] == F.col("__node"), "left")
        if self.merged is None:
            return rows.withColumn(out, F.col(taxid)).withColumn(known, F.col("__node").isNotNull()).drop("__node")
        merged = self.merged.groupBy(F.col("old").alias("__old")).agg(F.max("new").alias("__new"))
        rows = rows.join(merged, (F.col(taxid) == F.col("__old")) & F.col("__node").isNull(), "left")
        return rows.withColumn(out, F.coalesce("__node", "__new", taxid)).withColumn(known, F.col("__node").isNotNull() | F.col("__new").isNotNull()).drop("__node", "__old", "__new")

    def with_name(self, df: DataFrame, taxid: str = "taxid") -> DataFrame:
        """Add name: of the id or of what it was merged into; empty if there is none."""
        names = self.names.select(F.col("taxid").alias("__id"), F.col("name").alias("__name"))
        rows = self.resolved(df, taxid, "__to", "__known").join(names, F.col("__to") == F.col("__id"), "left")
        return rows.withColumn("name", F.coalesce("__name", F.lit(""))).drop("__to", "__known", "__id", "__name")

    def with_rank(self, df: DataFrame, taxid: str = "taxid") -> DataFrame:
        ranks = self.nodes.select(F.col("taxid").alias("__id"), F.col("rank").alias("__rank"))
        rows = self.resolved(df, taxid, "__to", "__known").join(ranks, F.col("__to") == F.col("__id"), "left")
        return rows.withColumn("rank", F.coalesce("__rank", F.lit(""))).drop("__to", "__known", "__id", "__rank")

    def with_lineage(self, df: DataFrame, taxid: str = "taxid", names: bool = False) -> DataFrame:
        """Add lineage (ids from the top, without the root; null for unknown ids) and, if asked, lineage_names."""
        paths = self.lineages()
        if names:
            of = self.names.select(F.col("taxid").alias("at"), "name")
            steps = paths.select("taxid", F.posexplode("path").alias("i", "at")).join(of, "at", "left")
            named = steps.groupBy("taxid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["name"]).alias("lineage_names"))
            paths = paths.join(named, "taxid")
        rows = self.resolved(df, taxid, "__to", "__known").join(paths.withColumnsRenamed({"taxid": "__id", "path": "lineage"}), F.col("__to") == F.col("__id"), "left")
        return rows.drop("__to", "__known", "__id")

    def below(self, pairs: DataFrame, taxid: str = "taxid", above: str = "above") -> DataFrame:
        """Add is_below: the first id is the second one or lies below it; false if either is unknown."""
        rows = self.resolved(self.resolved(pairs, taxid, "__a", "__ka"), above, "__b", "__kb")
        for side in "ab":
            rows = rows.join(self.numbered().select(F.col("taxid").alias(f"__i{side}"), F.col("pre").alias(f"__p{side}"), F.col("last").alias(f"__l{side}")), F.col(f"__{side}") == F.col(f"__i{side}"), "left")
        inside = F.coalesce((F.col("__pa") >= F.col("__pb")) & (F.col("__pa") <= F.col("__lb")), F.lit(False))
        return rows.withColumn("is_below", inside).drop(*[f"__{x}{s}" for x in ("", "k", "i", "p", "l") for s in "ab"])

    def lca(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """Add lca of the pair: 0 if either is 0 or unknown; equal ids are their own (known or not); of nodes that have no common
        ancestor the root."""
        rows = self.resolved(self.resolved(pairs, a, "__a", "__ka"), b, "__b", "__kb")
        for side in "ab":
            rows = rows.join(self.numbered().select(F.col("taxid").alias(f"__i{side}"), F.struct("depth", "inlabel", "ascendant").alias(f"__n{side}")), F.col(f"__{side}") == F.col(f"__i{side}"), "left")
        x, y = F.col("__na"), F.col("__nb")
        shift = lambda name, v, n: F.call_function(name, v, n)
        zeros = lambda v: F.bit_count(v.bitwiseAND(-v) - 1)
        one = F.lit(1).cast("long")
        # The path of the ancestor: the lowest bit, not below those in which the paths differ, that lies above both.
        low = F.greatest(_top_bit(x["inlabel"].bitwiseXOR(y["inlabel"])), zeros(x["inlabel"]), zeros(y["inlabel"]))
        common = shift("shiftleft", shift("shiftright", x["ascendant"].bitwiseAND(y["ascendant"]), low), low)
        rows = rows.withColumn("__j", zeros(common)).withColumn("__z", _path_at(x["inlabel"], F.col("__j")))
        for side, node in (("a", x), ("b", y)):
            # Where a node is not on that path itself, the next path below it on the node's way up hangs from the node sought.
            lower = node["ascendant"].bitwiseAND(shift("shiftleft", one, F.col("__j")) - 1)
            hangs = F.when((node["inlabel"] != F.col("__z")) & (x["inlabel"] != y["inlabel"]), _path_at(node["inlabel"], _top_bit(lower)))
            heads = self.heads().select(F.col("inlabel").alias(f"__h{side}"), F.col("above").alias(f"__u{side}"), F.col("depth").alias(f"__d{side}"))
            rows = rows.withColumn(f"__w{side}", hangs).join(heads, F.col(f"__w{side}") == F.col(f"__h{side}"), "left")
        at = lambda side, node: (F.when(F.col(f"__w{side}").isNull(), F.col(f"__{side}")).otherwise(F.col(f"__u{side}")), F.when(F.col(f"__w{side}").isNull(), node["depth"]).otherwise(F.col(f"__d{side}")))
        (p, p_depth), (q, q_depth) = at("a", x), at("b", y)
        found = F.when(p_depth <= q_depth, p).otherwise(q)
        rows = rows.crossJoin(F.broadcast(self.root()))  # one row
        lca = F.when((F.col(a) == 0) | (F.col(b) == 0), 0).when(F.col(a) == F.col(b), F.col(a)).when(~(F.col("__ka") & F.col("__kb")), 0).otherwise(F.coalesce(found, F.col("root")))
        return rows.withColumn("lca", lca.cast("long")).drop("root", "__j", "__z", *[f"__{x}{s}" for x in ("", "k", "i", "n", "h", "u", "d", "w") for s in "ab"])

    def at_or_below(self, df: DataFrame, rank: str, taxid: str = "taxid") -> DataFrame:
        """Add at_or_below: the node or one of its ancestors below the root has the rank."""
        ranks = self.nodes.where(F.col("rank") == rank.lower()).select(F.col("taxid").alias("__of"), (F.col("taxid") == F.col("parent")).alias("__root")).dropDuplicates(["__of"])
        nodes = self.numbered().join(ranks, F.col("taxid") == F.col("__of"), "left").withColumn("block", F.floor(F.col("pre") / BLOCK))
        # In depth-first order, a node lies below one of the rank if the farthest end of those that came before is not behind it.
        reach = F.when(~F.col("__root"), F.col("last"))
        inside = F.max(reach).over(Window.partitionBy("block").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
        ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        blocks = nodes.groupBy("block").agg(F.max(reach).alias("reach")).select("block", F.max("reach").over(ahead).alias("before"))
        marked = nodes.withColumn("reach", inside).join(blocks, "block").where((F.greatest("reach", "before") >= F.col("pre")) | F.col("__root")).select(F.col("taxid").alias("__id"))
        rows = self.resolved(df, taxid, "__to", "__known").join(marked, F.col("__to") == F.col("__id"), "left")
        return rows.withColumn("at_or_below", F.col("__id").isNotNull()).drop("__to", "__known", "__id")


def _top_bit(v: Column) -> Column:
    """The place of the highest bit of a positive number; 0 of 0."""
    return F.length(F.bin(v)) - 1


def _path_at(inlabel: Column, bit: Column) -> Column:
    """The number of the path that lies above another one and whose lowest bit is at a place."""
    high = F.call_function("shiftleft", F.call_function("shiftright", inlabel, bit + 1), bit + 1)
    return high.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))


def pair_key(a: Column, b: Column) -> Column:
    """One key for an unordered pair of 32-bit ids: the smaller in the upper half."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long"))
