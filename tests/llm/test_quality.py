import random

import numpy as np
import pytest

from plinth.llm import quality as q
from tests.llm.fixtures import ALL_IDS, SCHEMA, cluttered, empty, ids, odd


def made(n=700):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abdefghklmnprstu") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        good = rng.random() < 0.8
        kind = rng.randrange(3)
        text = " ".join(words) if good else " | ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words[:5] for _ in range(12))
        docs.append((i, text, "en", "a", 0))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made()
    df = spark.createDataFrame(docs, SCHEMA)
    voters = q.learn(df, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int"))
    got = {r.doc_id: r for r in q.quality(df, voters).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_votes_against_brute_force():
    docs, labels = made(200)
    texts = [t for _, t, *_ in docs]
    voters = q.Voters(texts[:150], [y for _, y in labels[:150]])
    for t, s in zip(texts[150:], voters.score(texts[150:]), strict=True):
        v = voters.unit(voters.scaled(q.features([t])) @ voters.axes)[0]
        cosine = voters.vectors @ v
        top = np.argsort(-cosine, kind="stable")[: q.NEIGHBOURS]
        w = np.exp(q.SHARPNESS * (cosine[top] - 1))
        assert abs((w * voters.labels[top]).sum() / w.sum() - s) < 1e-4


def test_chunks_change_nothing(monkeypatch):
    docs, _ = made(60)
    texts = [t for _, t, *_ in docs] + [None, "", "İa B  again again\nagain x " * 30, "again " * 50]
    whole = q.features(texts)
    for chunk in (100, 17, 3000):
        monkeypatch.setattr(q, "CHUNK", chunk)
        assert (q.features(texts) == whole).all()
    assert not whole[60:62].any()


def test_ties_and_empty_texts_have_a_defined_score():
    docs, labels = made(40)
    voters = q.Voters([t for _, t, *_ in docs] + ["same old words"] * 30, [y for _, y in labels] + [1] * 9 + [0] * 21)
    a, b = voters.score(["same old words", ""])
    assert a == pytest.approx(1.0) and b == pytest.approx((sum(y for _, y in labels) + 9) / 70)


def test_copies_vote_by_their_smallest_id(spark):
    rows = [(i, f"text number {i % 3} of these", "en", "a", 0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(9)], "doc_id long, quality int")
    for parts in (1, 5):
        voters = q.learn(df.repartition(parts), labels.repartition(parts))
        assert voters.labels.tolist() == [1.0] * 3


@pytest.mark.parametrize("make", [odd, cluttered])
def test_awkward_rows(spark, make):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (5, 0), (6, 1)], "doc_id long, quality int")
    out = q.quality(make(spark), q.learn(make(spark), labels))
    assert ids(out) == ALL_IDS and all(r.score is not None for r in out.collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality(empty(spark), q.learn(empty(spark), none)).count() == 0
    assert {r.score for r in q.quality(odd(spark), q.learn(odd(spark), none)).collect()} == {0.5}
