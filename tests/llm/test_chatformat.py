from pyspark.sql import functions as F

from plinth.llm.chatformat import CLOSE, mismatched, paired, preference, rendered
from tests.llm.fixtures import LONG

SCHEMA = "conv_id long, turn long, role string, text string"


def test_ties_are_compared_as_sets(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (0, 1, "assistant", "c"), (0, 1, "assistant", "d"), (1, 1, "assistant", "c"), (2, 0, "user", "x"), (2, 0, None, "x"), (3, 0, "user", None), (3, 0, "user", "x")]
    out = pairs(spark, rows)
    assert [(r.pair_id, r.part, r.turn) for r in out] == [(0, "prompt", 0)] * 2 + [(0, "chosen", 1)] * 2 + [(0, "rejected", 1)] + [(1, "chosen", 0)] * 2 + [(1, "rejected", 0)] * 2


def pairs(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
    pair, side = F.floor(F.col("conv_id") / 2).cast("long"), F.when(F.col("conv_id") % 2 == 0, "chosen").when(F.col("conv_id").isNotNull(), "rejected")
    return sorted(preference(df, pair, side).collect(), key=lambda r: (r.pair_id, {"prompt": 0, "chosen": 1, "rejected": 2}[r.part], r.turn is not None, r.turn))


def told(rows):
    return [(r.part, r.turn, r.trained) for r in rows]


def test_common_prefix_is_rendered_once(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (0, 3, "user", "more"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "more")]
    out = pairs(spark, rows)
    assert told(out) == [("prompt", 0, False), ("prompt", 1, False), ("chosen", 2, True), ("chosen", 3, False), ("rejected", 2, True), ("rejected", 3, False)]
    assert out[1].text == "<|user|>\nq\n<|end|>\n"


def test_prefix_against_plain_code(spark):
    import random

    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("xy")) for c in range(200) for t in range(rng.randrange(1, 5))]
    out = pairs(spark, rows)
    for p in range(100):
        a, b = ([r[2:] for r in rows if r[0] == c] for c in (2 * p, 2 * p + 1))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        mine = [r for r in out if r.pair_id == p]
        assert sum(r.part == "prompt" for r in mine) == n
        assert sum(r.part == "chosen" for r in mine) == len(a) - n and sum(r.part == "rejected" for r in mine) == len(b) - n


def test_equal_conversations_are_all_prompt(spark):
    assert {r.part for r in pairs(spark, [(0, 0, "user", "x"), (1, 0, "user", "x")])} == {"prompt"}


def test_awkward_rows(spark):
    rows = [(0, 0, "user", "x"), (0, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, None, None), (3, 0, None, None), (4, 0, "assistant", "alone"), (None, 0, "user", "x"), (6, None, "user", "first"), (6, 1, "assistant", "a"), (7, None, "user", "first"), (7, 1, "assistant", "b"), (8, 0, "user", "t1"), (8, 0, "user", "t2"), (9, 0, "user", "t2"), (9, 0, "user", "t1")]
    out = pairs(spark, rows, pair_id=1, side="x", part="y", each=2, one=3, parts_at=4, trained=5)
    by_pair = {p: told([r for r in out if r.pair_id == p]) for p in range(5)}
    assert by_pair[0] == by_pair[1] == [("prompt", 0, False)] and by_pair[2] == [("chosen", 0, True)]
    assert by_pair[3] == [("prompt", None, False), ("chosen", 1, True), ("rejected", 1, True)]
    assert by_pair[4] == [("prompt", 0, False)] * 2
    assert pairs(spark, [])  == []


def test_rendered_nulls(spark):
    assert spark.range(1).select(rendered(F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] == "<||>\n\n<|end|>\n"


def render(role, text):
    return f"<|{role or ''}|>\n{text or ''}{CLOSE}"


def test_paired_rows_against_plain_code(spark):
    import random

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x", "yé", "z😀"])) for c in range(120) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("q") for c in ("pair_id", "side", "part", "piece", "prompt", "chosen_mask", "place", "spans")})
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role, text))
    answers = {c: max((t, x) for t, r, x in own if r == "assistant") for c, own in by.items() if any(r == "assistant" for _, r, _ in own)}
    got = {r.pair_id: r for r in paired(preference(mismatched(df), F.col("pair_id"), F.col("side"))).collect()}
    assert set(got) == {c for c in answers if c + 1 in answers} and all(r.piece == 0 for r in got.values())
    for c, r in got.items():
        ends, answer = answers[c]
        sides = [[(role, text) for t, role, text in by[c] if t < ends] + [("assistant", a)] for a in (answer, answers[c + 1][1])]
        n = next((i for i, (x, y) in enumerate(zip(*sides)) if x != y), len(sides[0]))
        assert r.prompt == "".join(render(*x) for x in sides[0][:n])
        for own, text, mask in zip(sides, (r.chosen, r.rejected), (r.chosen_mask, r.rejected_mask)):
            assert text == "".join(render(*x) for x in own[n:])
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",") if s]
            assert [text[a:b] for a, b in spans] == [x + CLOSE for role, x in own[n:] if role == "assistant"]


def test_long_conversations_come_in_pieces(spark):
    rows = [(p, t, "assistant" if t % 2 else "user", f"{t}{'!' if p and t > 5 else ''}") for p in (0, 1) for t in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = preference(df, F.lit(3), F.when(F.col("conv_id") == 0, "chosen").otherwise("rejected"))
    whole, parts = paired(turns).first(), sorted(paired(turns, 8).collect(), key=lambda r: r.piece)
    assert len(parts) == 3 and sorted(paired(turns, 6).groupBy("pair_id").count().collect()) == [(3, 4)]
    for c in ("prompt", "chosen", "rejected"):
        assert "".join(r[c] for r in parts) == whole[c] != ""
    for r in [whole, *parts]:
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[int(a) : int(b)].endswith(CLOSE) for a, b in (s.split(":") for s in mask.split(",") if s))


def test_awkward_pairs(spark):
    rows = [(0, 0, "user", LONG), (0, 1, "assistant", None), (1, 0, None, None), (1, 1, "assistant", LONG), (1, 1, "assistant", "a"), (2, None, "assistant", "x"), (2, 0, "assistant", "b"), (None, 0, "assistant", "n"), (4, 0, "user", "alone")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.pair_id: r for r in paired(preference(mismatched(df), F.col("pair_id"), F.col("side"))).collect()}
    assert set(got) == {0, 1}
    assert got[0].prompt == render("user", LONG) and got[0].chosen == render("assistant", "") and got[0].rejected == render("assistant", LONG)
    assert got[1].prompt == render("", "") and got[1].chosen == render("assistant", LONG) and got[1].rejected == render("assistant", "b")
    assert paired(preference(mismatched(df.limit(0)), F.col("pair_id"), F.col("side"))).count() == 0
    some = paired(preference(df, F.col("conv_id"), F.lit("chosen"))).collect()
    assert sum(r.prompt == r.rejected == "" for r in some) == len(some) == 5  # null turns are a piece before the others
