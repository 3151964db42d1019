import random

import numpy as np
import pytest

from plinth.llm import decontam as d
from tests.llm.fixtures import ALL_IDS, SCHEMA, cluttered, empty, ids, odd


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.EQUAL if x == y else d.OTHER), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(map(max, h))


def test_alignment_against_the_full_table():
    rng = random.Random(3)
    pairs = [(np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))]), np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(1, 20))])) for _ in range(300)]
    assert d.align(pairs).tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs]


def test_pieces_change_nothing(monkeypatch):
    docs, items, _ = corpus()
    own, texts = d.Items(items), [t for _, t, *_ in docs] + [None, ""]
    words, begin = own.numbers(texts)
    own.seed(np.ones(len(own.number)), 10**6)
    found = d.leaks(texts, own, 0.4)
    monkeypatch.setattr(d, "CHUNK", 50)
    again = own.numbers(texts)
    assert (again[0] == words).all() and (again[1] == begin).all() and d.leaks(texts, own, 0.4) == found


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdefghklmnprstu") for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(12)]
    docs, want = [], {}
    for i in range(150):
        words = text(200)
        if i % 10 == 0:
            item = rng.randrange(12)
            own = items[item][1].split()
            for _ in range(i // 10 % 5):  # up to four edits
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = text(1)
            at = rng.randrange(200)
            words[at:at] = [w.upper() + "," for w in own]
            want[i] = item
        docs.append((i, " ".join(words), "en", "a", 0))
    return docs, items, want


@pytest.mark.parametrize("held", [d.HELD, 100])
def test_planted_passages_are_found(spark, held, monkeypatch):
    docs, items, want = corpus()
    monkeypatch.setattr(d.blocks, "__defaults__", (held,))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(df, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == want and len(got) == len(want)
    for r in got:
        a, b = items[r.item_id][1].split(), [w.lower().strip(",") for w in docs[r.doc_id][1].split()]
        assert r.score == pytest.approx(smith_waterman(a, b) / (d.EQUAL * len(a)))
    assert ids(d.decontaminate(df, bench)) == [i for i, *_ in docs if i not in want]


def test_a_passage_that_many_documents_hold(spark):
    docs, items, _ = corpus()
    docs = [(i, t + " " + items[0][1] if i % 3 else t, *rest) for i, t, *rest in docs]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in d.contamination(df, bench).collect() if r.item_id == 0} >= {i for i, *_ in docs if i % 3}


ITEMS = [(1, "the very same words stand here again and again"), (2, None), (3, ""), (4, "a"), (None, "words without number"), (1, "the very same words stand here again and again")]


@pytest.mark.parametrize("make", [odd, cluttered])
def test_awkward_rows(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = d.contamination(make(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in out) == [(6, 1, 1.0), (6, 1, 1.0), (7, 1, 1.0)]
    left = d.decontaminate(make(spark), bench)
    assert ids(left) == [x for x in ALL_IDS if x not in (6, 7)] and left.columns == make(spark).columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(odd(spark), none).count() == 0 and ids(d.decontaminate(odd(spark), none)) == ALL_IDS
    assert d.contamination(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_score_is_that_of_the_whole_text():
    rng = random.Random(8)
    item = [f"i{k}" for k in range(45)]
    texts = []
    for gap in (0, 5, 10, 20, 25, 40):
        other = lambda n: [f"o{rng.randrange(500)}" for _ in range(n)]
        texts.append(other(60) + item[:15] + other(gap) + item[15:30] + other(gap) + item[30:] + other(60))
    texts.append(item[:20] + ["o1"] * 30 + item + ["o2"] * 30 + item)
    own = d.Items([(1, " ".join(item))])
    own.seed(np.ones(len(own.number)), 10**6)
    found = d.leaks([" ".join(t) for t in texts], own, 0.4)
    for t, got in zip(texts, found, strict=True):
        share = smith_waterman(item, t) / (d.EQUAL * len(item))
        assert [round(s, 9) for _, s, *_ in got] == ([round(share, 9)] if share >= 0.4 else [])
    assert len(found[4]) == 1 and not found[5]
    assert found[-1] == [(0, 1.0, 42, 103)]  # of places alike the first, as narrow as seeds tell


def edited(rng, own, vocabulary, share):
    """So many of the words replaced, dropped or parted by a new one."""
    own = list(own)
    for k in sorted(rng.sample(range(len(own)), round(share * len(own))), reverse=True):
        own[k : k + rng.choice([1, 1, 1, 0])] = [rng.choice(vocabulary)] * rng.choice([1, 1, 1, 0]) or [rng.choice(vocabulary)]
    return own


@pytest.mark.parametrize("length", [8, 12, 30, 80])
def test_recall_against_every_alignment(spark, length):
    rng = random.Random(length)
    vocabulary = ["".join(rng.choice("abdefghklmnprstu") for _ in range(rng.randrange(2, 7))) for _ in range(3000)]
    text = lambda n: [vocabulary[min(int(rng.paretovariate(0.4)), 2999)] if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(length) for _ in range(8)]
    docs = []
    for i in range(160):
        words = text(120)
        if i % 4:
            at = rng.randrange(120)
            words[at:at] = edited(rng, rng.choice(items), vocabulary, 1 / 3)
        docs.append(words)
    want = {}
    for i, words in enumerate(docs):
        for k, item in enumerate(items):
            score = smith_waterman(item, words) / (d.EQUAL * len(item))
            if score >= d.THRESHOLD:
                want[i, k] = score
    df = spark.createDataFrame([(i, " ".join(w), "en", "a", 0) for i, w in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.contamination(df, bench).collect()}
    assert set(got) <= set(want) and all(got[x] <= want[x] + 1e-9 for x in got)
    assert len(want) > 40 and len(got) >= 0.95 * len(want) and sum(abs(got[x] - want[x]) < 1e-9 for x in got) >= 0.95 * len(got)


def test_short_items_count_where_they_are_rare(spark):
    docs = [(i, "the usual words of the corpus and more of the same " * 3000, "en", "a", 0) for i in range(8)]
    docs += [(20, "here stands photosynthesis once", "en", "a", 0), (21, "a Chloroplast membrane, too", "en", "a", 0), (22, "membrane chloroplast", "en", "a", 0)]
    bench = spark.createDataFrame([(1, "Photosynthesis"), (2, "chloroplast membrane"), (3, "the"), (4, "of the")], "item_id long, text string")
    out = d.contamination(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in out) in ([(20, 1, 1.0), (21, 2, 1.0)], [(21, 2, 1.0)])


def test_hot_phrases_are_worked_through_in_parts(monkeypatch):
    rng = random.Random(1)
    phrase = [f"p{k}" for k in range(6)]
    items = [(i, " ".join(phrase + [f"i{i}x{k}" for k in range(8)])) for i in range(200)]
    texts = [" ".join((phrase + [f"z{k}" for k in range(4)]) * 100 + items[7][1].split()), " ".join(phrase), items[3][1], None]
    own = d.Items(items)
    words, begin = own.numbers(texts)
    own.seed(np.ones(len(own.number)), 10**6)
    whole = d.leaks(texts, own, 0.5)
    assert [[f[:2] for f in x if f[1] == 1] for x in whole] == [[(7, 1.0)], [], [(3, 1.0)], []]
    monkeypatch.setattr(d, "POSTINGS", 500)
    assert d.leaks(texts, own, 0.5) == whole
    assert max(len(h[0]) for h in own.hits(words, begin)) < 20_000 < sum(len(h[0]) for h in own.hits(words, begin))


def test_a_benchmark_in_other_letters_is_held_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(d.blocks, "__defaults__", (12,))
    items = [(i, f"мама мыла раму номер{i} и ещё слово{i} дома{i}") for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, f"вот {t} конец", "ru", "a", 0) for i, t in items], SCHEMA)
    assert len(list(d.blocks(df, bench))) == 7
    assert {(r.doc_id, r.item_id) for r in d.contamination(df, bench).collect() if r.score == 1} == {(i, i) for i in range(10)}
