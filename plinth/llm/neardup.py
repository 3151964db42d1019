"""Near duplicates by bottom-k sketches from one hash function.

Each text's shingles are hashed once; its k smallest hashes are its sketch. Texts of equal shingle sets form a class, and one
representative of each goes on. Inverted lists of the retained values show which sketches overlap: two sets at the threshold share
so many of k values that each has one of them among its own rarest few, so only those are listed, and values that are common in the
corpus list nothing but texts made of them. Every list is compared with its most central member first, by union-sketch
estimate and then by exact Jaccard on full sets; that joins most groups at a cost linear in their size. In lists that still
hold several components, the members outside the largest one meet all members, exactly and in cells of bounded size, until no
link between different components is left.
"""

from __future__ import annotations

from itertools import pairwise
from math import comb, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm import shingles
from plinth.llm.common import fresh, settle, ship, sliced, spent

#: Retained values, and the chance that a pair at the threshold is missed by what its sketches have to share.
K, MISSED = 32, 1e-9
#: Members and shingles on either side of a cell, about.
TILE, TILE_SHINGLES = 300, 400_000
#: Ids that are sent to the texts whose full sets are needed; with more, texts and ids are joined by a shuffle.
SENT = 1_000_000


def least_shared(k: int | None, threshold: float) -> int:
    """Values that the sketches of two sets at the threshold share but for MISSED of all cases: of the k smallest of the
    union, each is in both sets with probability threshold, and then in both sketches. Whole sets (k None) know no such bound."""
    if k is None:
        return 2**31 - 1
    total = 0.0
    for t in range(k + 1):
        total += exp(log(comb(k, t)) + t * log(threshold) + (k - t) * log(1 - threshold)) if threshold < 1 else float(t == k)
        if total > MISSED:
            return max(1, t)
    return k


def _signature(own: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and two sums over it: equal for equal sets, and for others never by any likely chance."""
    return len(own), int(own.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(shingles.mixed(own), initial=0)) if len(own) else 0


def sketched(docs: DataFrame, width: int, k: int | None) -> DataFrame:
    """doc_id, n (distinct shingles), s1 and s2 (a signature of the set), sketch (its k smallest hashes) of every row."""

    def run(batches):
        for b in batches:
            n, s1, s2, sketch = [], [], [], []
            for own in (x for part in sliced(b.column(1)) for x in shingles.sets(part, width)):
                for c, x in zip((n, s1, s2), _signature(own), strict=True):
                    c.append(x)
                sketch.append(own[:k].view(np.int64))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sketch]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sketch, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *columns, lists], ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, s1, s2, full (sorted shingle hashes) of every row; rows that repeat the document before them are left out."""

    def run(batches):
        last, seen = None, set()
        for b in batches:
            ids, own, signs = [], [], []
            every = (x for part in sliced(b.column(1)) for x in shingles.sets(part, width))
            for i, x in zip(b.column(0).to_pylist(), every, strict=True):
                if i != last:
                    last, seen = i, set()
                if (sign := _signature(x)) not in seen:
                    seen.add(sign)
                    signs.append(sign)
                    ids.append(i)
                    own.append(x.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))
            columns = [pa.array(np.array([x[c] for x in signs], np.uint64).view(np.int64)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, lists], ["doc_id", "n", "s1", "s2", "full"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, full array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): component is the smallest node that can be reached.

    Labels sink to the smallest neighbour's and are then replaced by the label of the label, so long chains halve with each
    turn. Labels and edges stay in tables, and a turn's table goes once the next one is written; the driver sees whether any label moved.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        own = labels.select("node", "component")
        near = both.join(own, both["b"] == own["node"]).groupBy("a").agg(F.min("component").alias("least"))
        sunk = own.join(near, own["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "least").alias("c"))
        up = own.select(F.col("node").alias("c"), F.col("component").alias("above"))
        new = settle(sunk.join(up, "c", "left").select("node", "was", F.least("c", F.coalesce("above", "c")).alias("component")), "labels")
        still = new.where(F.col("was") != F.col("component")).isEmpty()
        spent(labels)
        labels = new
        if still:
            spent(both)
            return labels.select("node", "component")


def _alike(shared: Column, n: Column, m: Column, threshold: float) -> Column:
    hundredths = round(100 * threshold)
    return 100 * shared >= hundredths * (n + m - shared)


def _cell(t: pa.Table, hundredths: int) -> pa.Table:
    """Links that join components inside a cell (doc_id, component, asks, full), exactly: rows that ask meet all that don't. There
    are as many links as they join components, less one."""
    ids, asks, lists = t.column("doc_id").to_numpy(), t.column("asks").to_numpy(), t.column("full").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy().astype(np.int64)
    values = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    begin = np.concatenate(([0], np.cumsum(size)))
    _, group = np.unique(t.column("component").to_numpy(), return_inverse=True)
    held = np.repeat(~asks, size)
    holders = np.repeat(np.arange(len(size)), size)[held]
    order = np.argsort(values[held], kind="stable")
    holder, first = holders[order], np.searchsorted(values[held][order], np.arange(values.max(initial=-1) + 2))
    a, b = [], []
    for x in np.flatnonzero(asks).tolist():
        own = values[begin[x] : begin[x + 1]]
        n = first[own + 1] - first[own]
        where = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(holder[where], minlength=len(size))
        like = np.flatnonzero((100 * shared >= hundredths * (size[x] + size - shared)) & (group != group[x]) & ~asks)
        for y in like.tolist():
            if group[y] != group[x]:
                a.append(int(ids[x]))
                b.append(int(ids[y]))
                group[group == group[y]] = group[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_cells(hundredths: int):
    """_cell for each run of rows of one cell (list, i, j) in a sorted partition; one cell is held at a time."""

    def run(batches):
        parts, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for x, y in pairwise([0, *cut.tolist(), batch.num_rows]):
                if y > x:
                    if parts and key != (key := tuple(keys[x].tolist())):
                        yield from _cell(pa.Table.from_batches(parts), hundredths).to_batches()
                        parts = []
                    key = tuple(keys[x].tolist())
                    parts.append(batch.slice(x, y - x))
        if parts:
            yield from _cell(pa.Table.from_batches(parts), hundredths).to_batches()

    return run


def _links_in_lists(lists: DataFrame, found: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of found, of documents that one list holds.

    Only members outside the largest component of their list ask; they meet every member, in cells of about TILE of either side. So
    a member is sent once for each TILE of those that ask, and a list in which all but a few are joined costs about its size. Cells
    of one list are dealt to the partitions in turn, so a long list is spread evenly.
    """
    labelled = settle(lists.join(found, lists["doc_id"] == found["node"], "left").select("value", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "labelled")
    # Lists of one group of copies have nearly the same members, and mostly the same least member by hash: those are compared as one, their
    # union. Both members of a list of two were compared before.
    summed = labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), F.min(F.xxhash64("doc_id", F.lit(1))).alias("list"))
    still_open = settle(summed.where("low < high and size > 2").select("value", "list"), "open")
    united = settle(labelled.join(still_open, "value").select("list", "doc_id", "n", "component").distinct(), "united")
    spent(labelled, still_open)
    by_component = united.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("n", F.col("shingles").alias("main_shingles"), F.col("component").alias("main")))
    sizes = by_component.groupBy("list").agg(F.sum("n").alias("members"), F.sum("shingles").alias("shingles"), largest.alias("l"))
    tiles = lambda n, shingles: F.greatest(F.ceil(n / TILE), F.ceil(shingles / TILE_SHINGLES)).cast("int")
    sizes = settle(sizes.select("list", "l.main", tiles(F.col("members"), F.col("shingles")).alias("all"), tiles(F.col("members") - F.col("l.n"), F.col("shingles") - F.col("l.main_shingles")).alias("asking")), "sizes")
    members = united.join(sizes, "list")
    spread = lambda of, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = members.where("component <> main").select("list", spread("asking", 2).alias("i"), every("all").alias("j"), "doc_id", "component", F.lit(True).alias("asks"), "all")
    answering = members.select("list", every("asking").alias("i"), spread("all", 3).alias("j"), "doc_id", "component", F.lit(False).alias("asks"), "all")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = asking.union(answering).join(full, "doc_id")
    turn = F.pmod(F.col("list") + F.col("i").cast("long") * F.col("all") + F.col("j"), F.lit(parts)).cast("int")
    dealt = cells.repartitionById(parts, turn).select("list", F.col("i").cast("long"), F.col("j").cast("long"), "doc_id", "component", "asks", "full").sortWithinPartitions("list", "i", "j")
    links = settle(dealt.mapInArrow(_in_cells(round(100 * threshold)), "a long, b long").distinct(), "links")
    spent(united, sizes)
    return links


class Linked:
    """What near_duplicates found: every row's signature, classes of equal sets with the component of their text, and ids on several texts."""

    def __init__(self, docs: DataFrame, width: int, threshold: float, k: int | None):
        ship(docs.sparkSession)
        need = least_shared(k, threshold)
        self.every = every = settle(sketched(docs, width, k), "sketches")
        self.linkable = linkable = every.where("n > 0 and doc_id is not null")
        # An id on rows of different texts is one document.
        sign = F.struct("n", "s1", "s2")
        self.reused = settle(every.where("doc_id is not null").groupBy("doc_id").agg(F.min(sign).alias("low"), F.max(sign).alias("high")).where("low <> high").select("doc_id"), "reused")
        self.some_reused = not self.reused.isEmpty()
        classes = self._nodes(settle(linkable.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "sketch")).alias("least")).select("n", "s1", "s2", "least.doc_id", "least.sketch"), "classes"))

        # Retained values that several classes hold; a class needs as many as a partner at the threshold would share. Counts by value
        # are written before rows are joined with them: a join of two plain shuffles splits the partition of a hot value.
        values = classes.select("node", "n", F.explode("sketch").alias("value"))
        common = settle(values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "common")
        wanted = F.least(F.lit(need), F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).cast("int")
        ordered = values.join(common, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("rare"))
        ordered = ordered.withColumn("spare", F.size("rare") - wanted).where("spare >= 0")
        central = F.aggregate("rare", F.lit(0).cast("long"), lambda x, r: x + r["held"])
        lists = settle(ordered.select(F.col("node").alias("doc_id"), "n", central.alias("central"), F.explode(F.slice("rare", F.lit(1), F.col("spare") + 1)).alias("r")).select(F.col("r.value").alias("value"), "doc_id", "n", "central"), "lists")
        spent(common)

        # First each list against its most central member.
        heads = lists.groupBy("value").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("down"))).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
        heads = settle(heads.select("value", (-F.col("head.down")).alias("head"), "size"), "heads")
        pairs = lists.join(heads, "value").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
        sketches = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        overlap = F.size(F.array_intersect("sketch_a", "sketch_b"))
        estimated = pairs.join(sketches("a"), "a").join(sketches("b"), "b").where(overlap >= F.least(F.lit(need), F.ceil(threshold * F.greatest("n_a", "n_b") - 1e-9)))
        pairs = settle(estimated.select("a", "b"), "pairs")
        # Full sets of what is compared: those pairs, and members of lists of more than two.
        longer = lists.join(heads.where("size > 2").select("value"), "value", "left_semi").select("doc_id")
        involved = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(longer).distinct(), "involved")
        full = self._full(docs, classes, involved, width)
        sets = lambda side: full.select(F.col("doc_id").alias(side), F.col("full").alias(f"full_{side}"))
        shared = F.size(F.array_intersect("full_a", "full_b"))
        exact = pairs.join(sets("a"), "a").join(sets("b"), "b").where(_alike(shared, F.size("full_a"), F.size("full_b"), threshold)).select("a", "b")
        found = components(exact)
        spent(heads, pairs, involved)

        names = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        more = _links_in_lists(lists, found, full, threshold)
        spent(lists, full)
        final = _relabelled(found, components(more.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))))
        of_text = classes.select("n", "s1", "s2", "doc_id", "node").join(final, "node", "left").select("n", "s1", "s2", "doc_id", F.coalesce("component", "node").alias("of_text"))
        if self.several:  # a component is told by its smallest doc_id, which its smallest node need not be
            least = of_text.groupBy("of_text").agg(F.min("doc_id").alias("least"))
            of_text = of_text.join(least, "of_text").withColumn("of_text", F.col("least"))
        self.of_text = settle(of_text.select("n", "s1", "s2", "of_text"), "of_text")
        spent(self._written, more)

    def _nodes(self, classes: DataFrame) -> DataFrame:
        """classes with a node of each: its doc_id, or a hash where that id stands for another class as well."""
        self.several, self._written = False, classes
        if not self.some_reused:
            return classes.withColumn("node", F.col("doc_id"))
        own = classes.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").select("doc_id", "first")
        own = settle(own, "several")
        self.several = not own.isEmpty()
        if not self.several:
            return classes.withColumn("node", F.col("doc_id"))
        node = F.when(F.col("first").isNull() | (F.col("first") == F.struct("n", "s1", "s2")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "n", "s1", "s2"))
        self._written = settle(classes.join(own, "doc_id", "left").withColumn("node", node).drop("first"), "classes")
        spent(classes)
        return self._written

    def _full(self, docs: DataFrame, classes: DataFrame, involved: DataFrame, width: int) -> DataFrame:
        """doc_id (the node), full of the nodes involved."""
        if not self.several:
            return settle(full_sets(self._texts(docs, involved), width).select("doc_id", "full"), "full")
        nodes = classes.select("node", "doc_id", "n", "s1", "s2").join(involved.withColumnRenamed("doc_id", "node"), "node")
        nodes = settle(nodes, "nodes")
        sets = full_sets(self._texts(docs, nodes.select("doc_id").distinct()), width).drop("doc_id")
        return settle(sets.join(nodes.select("node", "n", "s1", "s2"), ["n", "s1", "s2"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "full"), "full")

    def _texts(self, docs: DataFrame, involved: DataFrame) -> DataFrame:
        """doc_id and text of the documents involved. Few ids go to the texts, which then stay where they are, unless rows repeat an
        id; else texts and ids are shuffled, and the rows of an id stand together."""
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        if involved.count() <= SENT:
            again = self.linkable.join(involved, "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1")
            if again.isEmpty():
                return texts.join(F.broadcast(involved), "doc_id", "left_semi").select("doc_id", "text")
        return texts.join(involved, "doc_id").select("doc_id", "text").sortWithinPartitions("doc_id")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int | None = K) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept for every row; docs: doc_id, text.

    Documents are linked if the Jaccard similarity of their sets of width-word shingles is at least threshold (compared in
    hundredths, exactly); component_id is the smallest doc_id that links reach, and kept is doc_id = component_id. With k
    values a sketch may miss a pair at the threshold once in 10^9; k=None keeps whole sets and misses none, at the cost of longer lists.
    Null and empty texts, and those of white space, have no shingles and link with nothing. Rows that share a doc_id are one document,
    linked by any of its texts, and all have its component. A row with a null doc_id has a null component, links with nothing and is
    kept. An empty table gives an empty result.
    """
    found = Linked(docs, width, threshold, k)
    rows = found.every.select("doc_id", "n", "s1", "s2").join(found.of_text, ["n", "s1", "s2"], "left")
    if not found.some_reused:
        return _answer(rows.withColumn("component", F.when(F.col("n") > 0, F.col("of_text"))))
    # Components of texts are joined where an id is on several of them; rows without shingles go with the other texts of their id.
    own = found.linkable.join(found.reused, "doc_id").select("doc_id", "n", "s1", "s2").distinct().join(found.of_text, ["n", "s1", "s2"])
    merged = settle(components(own.select(F.col("doc_id").alias("a"), F.col("of_text").alias("b"))), "merged")
    text = merged.select(F.col("node").alias("of_text"), F.col("component").alias("by_text"))
    of_id = merged.join(found.reused, merged["node"] == found.reused["doc_id"], "left_semi").select(F.col("node").alias("doc_id"), F.col("component").alias("by_id"))
    return _answer(rows.join(text, "of_text", "left").join(of_id, "doc_id", "left").withColumn("component", F.coalesce("by_id", F.when(F.col("n") > 0, F.coalesce("by_text", "of_text")))))


def _relabelled(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels of the first graph, and of nodes that only the second has, by the second graph's components."""
    again = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = found.join(again, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = merged.join(found.select("node"), "node", "left_anti")
    return old.union(alone.select("node", "component"))


def _answer(rows: DataFrame) -> DataFrame:
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int | None = K) -> DataFrame:
    """docs without copies: of texts that links join, the rows of the smallest doc_id stay; all columns as they are.

    Here a row goes only if another id keeps a text that its own text is linked with, so where an id is on rows of different texts, no text is
    lost with another. Rows without shingles or without an id stay, and so do rows that repeat a row that stays. An empty table gives an
    empty result.
    """
    found = Linked(docs, width, threshold, k)
    name, sign = fresh("_gone", docs), fresh("_sign", docs)
    rows = found.linkable.select("doc_id", "n", "s1", "s2").join(found.of_text, ["n", "s1", "s2"]).where("doc_id <> of_text")
    gone = rows.join(found.reused, "doc_id", "left_anti").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    if not found.some_reused:
        return left

    @F.arrow_udf("string")
    def signed(text: pa.Array) -> pa.Array:
        return pa.array([_written(x) for part in sliced(text) for x in shingles.sets(part, width)], pa.string())

    one = rows.join(found.reused, "doc_id").select(F.col("doc_id").alias(name), F.concat_ws(":", "n", "s1", "s2").alias(sign)).distinct()
    again = settle(found.reused.select(F.col("doc_id").alias(name)), "again")
    plain = left.join(again, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    mixed = left.join(again, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    one = one.withColumnRenamed(sign, own := fresh("_own", docs))
    mixed = mixed.withColumn(sign, signed(F.col("text").cast("string"))).join(one, (F.col("doc_id").cast("long") == F.col(name)) & (F.col(sign) == F.col(own)), "left_anti")
    return plain.union(mixed.select(*docs.columns))


def _written(own: np.ndarray) -> str:
    """A signature as the text of its three numbers, the sums as signed longs."""
    n, s1, s2 = _signature(own)
    return f"{n}:{s1 - 2**64 * (s1 >> 63)}:{s2 - 2**64 * (s2 >> 63)}"
