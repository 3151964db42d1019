import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import neardup, shingles
from tests.llm.fixtures import ALL_IDS, SCHEMA, cluttered, empty, ids, odd


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(docs, width, hundredths=80):
    sets = [(i, plain_set(t, width)) for i, t, *_ in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= hundredths * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}


def edited(rng, words, vocabulary, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2) or [rng.choice(vocabulary)]
    return words


def corpus(seed=1, n=60, group=70):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdefghklmnprstu") for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    docs, hot = [], [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))] + common * rng.randrange(2)
        docs += [" ".join(edited(rng, base, vocabulary, rng.randrange(4))) for _ in range(rng.randrange(1, 4))]
    docs += [" ".join(edited(rng, hot, vocabulary, rng.randrange(12))) for _ in range(group)] + [" ".join(common)] * 5 + ["A B C D", "a b c d"]
    rng.shuffle(docs)
    return [(i, t, "en", "a", 0) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "width", "tile"), [(1, 4, neardup.TILE), (2, 5, 9)])
def test_against_brute_force(spark, seed, width, tile, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", tile)
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=width).collect()}
    assert got == brute(docs, width)


@pytest.mark.parametrize("seed", [5])
def test_whole_sets_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 11)
    monkeypatch.setattr(neardup, "SENT", 0)
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=4, k=None).collect()}
    assert got == brute(docs, 4)


def test_sets_have_the_right_sizes_in_any_chunks(monkeypatch):
    texts = [t for _, t, *_ in corpus(4)] + [None, "", " \n", "Ä Ä ä A a", "x" * 9000 + " y"]
    whole = [s.tolist() for s in shingles.sets(texts, 4)]
    assert [len(s) for s in whole] == [len(plain_set(t, 4)) for t in texts]
    monkeypatch.setattr(shingles, "CHUNK", 50)
    assert [s.tolist() for s in shingles.sets(texts, 4)] == whole
    assert [next(shingles.sets([t], 4)).tolist() for t in texts] == whole
    a, b = (set(x.tolist()) for x in shingles.sets(["p q r s t", "P Q R S x"], 4))
    assert len(a & b) == 1


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_least_shared_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    need = neardup.least_shared(neardup.K, 0.8)
    for _ in range(2000):
        both, only = rng.integers(0, 2**63, 400), rng.integers(0, 2**63, 100)
        a, b = np.sort(np.concatenate((both, only[:50])))[: neardup.K], np.sort(np.concatenate((both, only[50:])))[: neardup.K]
        assert len(np.intersect1d(a, b)) >= need


@pytest.mark.parametrize("make", [odd, cluttered])
def test_awkward_rows(spark, make):
    out = neardup.near_duplicates(make(spark).select("doc_id", "text"))
    assert ids(out) == ALL_IDS
    by_id = {r.doc_id: r for r in out.collect()}
    assert [(by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) for i in (1, 2, 3, 5)] == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 5, True)]
    assert (by_id[7].component_id, by_id[7].kept, by_id[6].kept) == (6, False, True)
    assert by_id[None].component_id is None and by_id[4].n_shingles == 29_996
    left = neardup.deduplicate(make(spark))
    assert ids(left) == [x for x in ALL_IDS if x != 7] and left.columns == make(spark).columns


def test_repeated_rows_are_held_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 0)] * 300 + [(2, text + " more", "en", "a", 0)] * 300 + [(3, "w1 " + text, "en", "a", 0), (3, "other words", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    full = neardup.full_sets(df.select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id"), 5)
    assert full.count() == 4 and full.select("n", "s1", "s2").distinct().count() == 4
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.deduplicate(odd(spark).where(F.col("doc_id") < 3)).count() == 2


def test_rows_of_one_id_get_one_component(spark):
    a, b, c = ("one two three four five six seven", "quite other words stand in this one here", "a third text of seven plain words")
    rows = [(5, a), (9, a), (3, b), (5, b), (7, c), (8, c), (8, ""), (6, None), (6, "nothing is like this text at all")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=4).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 7, True), (8, 7, False), (6, 6, True)}


def test_no_text_goes_with_another_of_its_id(spark):
    rows = [(5, "a b c d e"), (7, "a b c d e"), (7, "x y z w v"), (9, "X Y z w v"), (9, ""), (9, None), (4, "only one"), (4, "only one")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).withColumns({"_gone": F.lit(1), "_sign": F.lit(2), "n": F.lit(3)})
    assert sorted((r.doc_id, r.text or "") for r in neardup.deduplicate(df).collect()) == [(4, "only one"), (4, "only one"), (5, "a b c d e"), (7, "x y z w v"), (9, ""), (9, "")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (4, 4)}


@pytest.mark.parametrize("seed", [7])
def test_brute_force_with_ids_on_several_texts(spark, seed):
    rng = random.Random(seed)
    docs = [(i if rng.random() < 0.8 else rng.randrange(90), *rest) for i, *rest in corpus(seed, n=30, group=20)]
    sets, want = [(i, plain_set(t, 4)) for i, t, *_ in docs], {i: i for i, *_ in docs}
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while moved := [(i, j) for i, j in links if want[i] != want[j]]:
        for i, j in moved:
            want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=4).collect()}
    assert got == want


def test_near_copies_and_other_texts_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (7, text + " more"), (7, "quite another text of seven words"), (8, "quite another text of seven words"), (3, "w1 " + text), (3, "and a third text of one id")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, len(r.text)) for r in neardup.deduplicate(df).collect()) == sorted([(3, len("w1 " + text)), (3, 26), (7, 33)])
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(3, 3), (5, 3), (7, 3), (8, 3)}
