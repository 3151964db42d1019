"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once.

Both conversations of a pair are compared turn by turn through one aggregate on (pair, position); the prefix ends at the
least position that differs. Turns after it are the two completions, and only what the assistant says in them is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import settle

#: What opens and closes a rendered turn.
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
TRAINED = "assistant"
#: Turn numbers of one piece of a pair: what one row holds at most.
PIECE = 256


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; a null role renders as the empty role, a null text as the empty text."""
    return F.concat(F.lit(OPEN.split("{}")[0]), F.coalesce(role, F.lit("")), F.lit(OPEN.split("{}")[1]), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def preference(conversations: DataFrame, pair: Column, side: Column) -> DataFrame:
    """Preference rows by turn: pair_id, part (prompt, chosen, rejected), turn, text, trained.

    side is 'chosen' or 'rejected'. The longest common prefix of the two sides is the part prompt, once; the turns
    after it are the parts chosen and rejected, with trained true for assistant turns only. A part's text is its rows' texts
    in order of turn, so a conversation of any length needs no row or task that holds it whole. A pair with one side only has no
    prompt and an empty other completion. A turn with several rows, as with ties, is common if both sides have the same set
    of them, and stays several rows; repeated rows count once; a null turn comes first; rows with a null pair or side take no
    part. An empty table gives an empty result.
    """
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    rows = conversations.select(pair.alias("pair_id"), side.alias("side"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("pair_id is not null and side is not null").distinct()
    # A side's rows at a turn are told by their number and two sums of hashes, so that none of them has to be gathered.
    place = _place()
    hashes = [F.xxhash64(F.lit(salt), F.struct("role", "text")) for salt in (1, 2)]
    sums = [F.struct(*[F.bit_xor(F.when(F.col("side") == s, h)) for h in hashes], F.count_if(F.col("side") == s)) for s in ("chosen", "rejected")]
    places = rows.groupBy("pair_id", place.alias("place")).agg(sums[0].alias("chosen"), sums[1].alias("rejected"))
    parts = settle(places.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("place").alias("parts_at")), "parts")
    joined = rows.join(parts, "pair_id", "left").withColumn("common", F.col("parts_at").isNull() | (place < F.col("parts_at")))
    out = joined.where(~F.col("common") | (F.col("side") == "chosen"))
    part = F.when(F.col("common"), "prompt").otherwise(F.col("side"))
    trained = ~F.col("common") & F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return out.select("pair_id", part.alias("part"), "turn", rendered(F.col("role"), F.col("text")).alias("text"), trained.alias("trained"))


def _place() -> Column:
    return F.coalesce("turn", F.lit(-(2**63)))


def paired(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row per pair, from the rows of preference(): pair_id, piece, prompt, chosen, rejected, chosen_mask, rejected_mask.

    A mask lists the spans start:end (characters, end exclusive, joined by commas) of its completion that are trained on: what
    the assistant says, with the sign that closes the turn and without its heading. Turns of the same number stand in order of
    their text. A pair is one row, unless its turn numbers span several pieces of `piece` numbers: then it has a row for each, whose
    texts follow one another in order of piece and whose masks count from the piece's own beginning; so no row grows with a
    conversation without end. A part without turns is empty, null turns are in the first piece, an empty table gives no row.
    """
    row = F.struct(_place().alias("place"), "text", "trained")
    at = F.floor(_place() / piece).cast("long") if piece & (piece - 1) else F.shiftright(_place(), piece.bit_length() - 1)
    parts = ("prompt", "chosen", "rejected")
    gathered = turns.groupBy("pair_id", at.alias("piece")).agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, row))).alias(p) for p in parts])
    texts = [F.array_join(F.transform(p, lambda x: x["text"]), "").alias(p) for p in parts]
    return gathered.select("pair_id", "piece", *texts, *[_mask(F.col(p)).alias(f"{p}_mask") for p in parts[1:]])


def _mask(rows: Column) -> Column:
    heading = len(OPEN.format(TRAINED))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(done: Column, x: Column) -> Column:
        end = done["at"] + F.char_length(x["text"])
        span = F.concat_ws(":", (done["at"] + heading).cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["trained"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(rows, none, add, lambda done: F.array_join(done["spans"], ","))


def mismatched(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations, as rows pair_id, side, turn, role, text: each conversation is preferred to itself with a wrong answer.

    A conversation ends with its last assistant turn (of several rows there, the greatest text). Its rejected side has in that
    place the last answer of the conversation whose id is one higher. Conversations without an answer, or without such a neighbour,
    make no pair; rows without conv_id or turn take no part.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair_id is not null and turn is not null")
    last = rows.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = settle(last.select("pair_id", F.col("last.turn").alias("ends"), F.col("last.text").alias("answer")), "answers")
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("answer").alias("wrong"))
    both = last.join(other, "pair_id")
    sides = F.array(F.lit("chosen"), F.lit("rejected"))
    before = rows.join(both.select("pair_id", "ends"), "pair_id").where("turn < ends").select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    answers = both.withColumn("side", F.explode(sides)).select("pair_id", "side", F.col("ends").alias("turn"), F.lit(TRAINED).alias("role"), F.when(F.col("side") == "chosen", F.col("answer")).otherwise(F.col("wrong")).alias("text"))
    return before.union(answers)
