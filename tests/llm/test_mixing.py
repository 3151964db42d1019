import random
import re

import pytest

from plinth.llm import mixing
from tests.llm.fixtures import ALL_IDS, CLASHING, SCHEMA, cluttered, empty, ids, odd


def brute_targets(sizes, weights, share, epochs):
    """Excess over clamps is handed round until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total, given = sum(w[s] for s in open_), left
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += given * w[s] / total
        for s in list(open_):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
                open_.remove(s)
    return target


def documents(spark, seed, sources=7):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(1.1)) % 3000)), "en", rng.choice(["src0"] * sources + [f"src{k}" for k in range(sources)] + ["é", "Z", None]), 0) for i in range(600)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sent", [0, 50_000])
def test_against_repeated_sharing(spark, seed, sent, monkeypatch):
    monkeypatch.setattr(mixing, "SENT", sent)
    rows, df = documents(spark, seed)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    by_source = {}
    for i, _, _, s, _ in rows:
        by_source[s] = by_source.get(s, 0) + size[i]
    want = brute_targets(by_source, [5, 2, 1], 1.5, 2)
    got = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken, cut = {}, {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.whole * r.size <= r.taken
        taken[r.source] = taken.get(r.source, 0) + r.taken
        cut[r.source] = cut.get(r.source, 0) + (r.taken != r.whole * r.size)
    assert all(abs(t - want[s]) <= 1 for s, t in taken.items())
    assert all(n <= 1 for n in cut.values()) and sum(cut.values()) >= 1  # whole documents, but for one of a source
    assert len({r.whole for r in got}) > 1
    rows = mixing.repetitions(mixing.mix(df)).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append((r.repetition, r.words))
    for r in got:
        own = sorted(of.get(r.doc_id, []))
        assert sum(w for _, w in own) == r.taken and [k for k, _ in own] == list(range(1, len(own) + 1)) and all(w == r.size for _, w in own[:-1])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_the_sample_follows_the_seed(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = ({r.doc_id: r.whole for r in mixing.mix(df, share=0.9, seed=s).collect()} for s in ("x", "y"))
    assert a != b and set(a.values()) == {0, 1}


def test_rows_of_one_id_share_the_cut(spark):
    df = spark.createDataFrame([(7, "one two three four five", "en", "a", 0)] * 30, SCHEMA)
    got = mixing.mix(df, share=0.5).collect()
    assert [(r.whole, r.taken) for r in got] == [(0, 2)] * 30  # half of 150 words is 2.5 of each row


def test_awkward_rows(spark):
    out = mixing.mix(odd(spark))
    assert ids(out) == ALL_IDS
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].size == by_id[2].taken == by_id[3].size == 0 and by_id[4].size == 30_000
    assert by_id[5].source_size == 1 and by_id[5].target <= 2
    assert mixing.mix(empty(spark)).count() == 0


def test_clashing_columns(spark):
    df = cluttered(spark)
    out = mixing.mix(df, keep=df.columns)
    assert ids(out) == ALL_IDS and set(CLASHING) <= set(out.columns)
    assert {r.doc_id: r.size for r in out.collect()}[4] == 30_000


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2
