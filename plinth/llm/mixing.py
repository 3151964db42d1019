"""Mixing sources to target weights by capped water-filling (native: DataFrame functions only).

Weights are shared over the sources; a source is clamped at max_epochs times its own size and the excess goes to the
others in proportion to their weights, until none is above its clamp. The fixed point has a closed form: sort sources by
clamp / weight, and the clamped ones are a prefix. One row per source takes part in that step, never the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.llm.common import WORD, fresh, settle, spent

#: Bits of a document's place in the seeded order of its source, and how many of them tell places apart at each step of the search for a
#: source's cut: words are summed by the first bits, then by the next ones inside the one sum that the cut falls in, and so on.
PLACE_BITS, STEPS = 60, (8, 16, 60)
#: Sources whose targets are sent to every task, so that documents stay where they are. With more sources the join deals
#: documents by source and salt; a hot source then spreads over so many tasks.
SENT, SALTS = 50_000, 64


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null or white space only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source: source, source_size, target. sizes: (source, size) rows, source may be null.

    Sources by code point, null last, take the weights in turn, repeating. Sources are catalogue entries, so the global
    order below runs over one row per source, after a partial aggregate that also takes the heat out of hot sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Binary order of UTF-8 is code point order.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", turn).withColumn("clamp", max_epochs * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    s = (
        s.withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("left_words", F.col("wanted") - F.coalesce(F.sum("clamp").over(before), none))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none))
        .withColumn("clamped", F.col("clamp") * F.col("left_weight") <= F.col("left_words") * F.col("weight"))
        .withColumn("words", F.col("wanted") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("clamp"))).over(everything), none))
        .withColumn("open_weight", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("clamped"), F.col("clamp")).otherwise(F.col("words") * F.col("weight") / F.col("open_weight"))
    return s.select("source", "source_size", target.alias("target"))


def cuts(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with extra (words above whole repetitions), cut_at, cut_before, cut_size: where in its order a source's extra words end.

    placed: (source, at, size) rows. Words are summed by source and the first bits of `at`, and only the rows of the sum in which a source's
    extra words end are looked at by their next bits; so no task orders more than 256 sums of a source, or a 65536th of its rows.
    """
    extra = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    t = targets.withColumn("extra", F.when(F.col("source_size") > 0, extra).otherwise(0.0))
    cut, known = t.select("source", "extra", F.lit(0).cast("long").alias("before")), 0
    for bits in STEPS:
        prefix, n = F.shiftright("at", PLACE_BITS - bits).alias("prefix"), F.sum("size").alias("n")
        if known:
            inside = _met(placed.withColumn("prefix", F.shiftright("at", PLACE_BITS - known)), cut, "prefix")
            sums = inside.groupBy("source", "extra", "before", prefix).agg(n)
        else:  # all rows take part, so they are summed before any of them moves by its source
            sums = _met(placed.groupBy("source", prefix).agg(n), cut)
        lower = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("before", F.col("before") + lower).where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("n")))
        cut, known = settle(ends, "cut"), bits
    return _met(t, cut.select("source", F.col("prefix").alias("cut_at"), F.col("before").alias("cut_before"), F.col("n").alias("cut_size")), how="left")


def _met(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """left joined with right on source (null is a source) and the columns `more`; right's other columns are added."""
    on = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n")]
    right = right.select(*on, *[F.col(c) for c in right.columns if c != "source"])
    return left.select("*", *on).join(right, ["_s", "_n", *more], how).drop("_s", "_n")


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", keep: list[str] = ("doc_id", "source")) -> DataFrame:
    """Returns the columns keep of every document, then size, source_size, target, whole, taken; those names of docs give way.

    A source's target is so many whole repetitions of all its documents, and one more of a seeded sample of them: in the order
    that seed and doc_id draw, whole documents until the target is met. whole is a document's number of whole repetitions, taken its
    words in the mix. The document in which the target falls gives its part of it (rows that share the draw give equal parts), so a
    source's words meet its target but for one word a row there, however skewed its document sizes are; all others are
    taken wholly or not at all, and none exceeds max_epochs times its size rounded up to a repetition. Reruns, lost executors and other
    partitionings agree. Null or empty texts have size 0 and take 0; a null source is a source; a null doc_id draws as the
    empty text; repeated rows count each; an empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "whole", "taken")
    keep = [c for c in keep if c not in made]
    key = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, PLACE_BITS // 4), 16, 10).cast("long")
    size = word_count(F.col("text"))
    placed = settle(docs.select(F.col("source").cast("string").alias("source"), draw.alias("at"), size.alias("size")), "sizes")
    targets = settle(source_targets(placed.select("source", "size"), list(weights), share, max_epochs), "targets")
    goals = settle(cuts(placed, targets), "cuts")
    spent(placed, targets)
    names = {c: fresh(f"_{c}", docs) for c in ("source", "at", "extra", "cut_at", "cut_before", "cut_size")}
    goals = goals.select(*[F.col(c).alias(names.get(c, c)) for c in goals.columns])
    sized = docs.select(*dict.fromkeys([*keep, "doc_id", "source"]), draw.alias(names["at"]), size.alias("size"))
    here = F.col("source").cast("string").eqNullSafe(F.col(names["source"]))
    if goals.count() <= SENT:
        joined = sized.join(F.broadcast(goals), here, "left")
    else:
        slot, salt = fresh("_slot", docs), fresh("_salt", docs)
        salted = goals.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, here & (F.col(salt) == F.col(slot)), "left")
    at, extra, cut_at, cut_before, cut_size = (F.col(names[c]) for c in ("at", "extra", "cut_at", "cut_before", "cut_size"))
    part = F.floor(F.col("size") * (extra - cut_before) / cut_size).cast("long")
    more = F.when(at < cut_at, F.col("size")).when(at == cut_at, part).otherwise(0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    taken = (epochs * F.col("size") + more).alias("taken")
    whole = (epochs + F.when(more == F.col("size"), F.when(F.col("size") > 0, 1).otherwise(0)).otherwise(0)).alias("whole")
    return joined.select(*keep, "size", "source_size", "target", whole.cast("long").alias("whole"), taken)


def repetitions(mixed: DataFrame) -> DataFrame:
    """mixed, the result of mix(), with a row for each repetition of a document: repetition (from 1), and words, how many of its words it gives.

    words is the document's size, but for the one document of a source that its target cuts. Documents that take nothing have no row.
    """
    n = F.ceil(F.col("taken") / F.col("size"))
    out = mixed.where("taken > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return out.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("repetition") - 1) * F.col("size")))
