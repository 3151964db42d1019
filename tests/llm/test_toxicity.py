import random

import pytest
from pyspark.sql import functions as F

from plinth.llm import toxicity as tox
from tests.llm.fixtures import ALL_IDS, SCHEMA, cluttered, empty, ids, odd


def distance(a, b):
    """Edits, where two neighbours that changed places are one."""
    rows = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


TERMS = ("idiot$", "scum$", "clown$", "achlich", "loser$", "closer$")


def test_automaton_against_edit_distance():
    own = tox.Automaton(TERMS)
    rng = random.Random(4)
    words = []
    for _ in range(4000):
        w = list(rng.choice(["idiot", "scum", "clown", "achlichkeit", "loser", "closer", "other", "achlic"]))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.3:
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k : k + rng.randrange(2)] = [rng.choice("idotclwnsrexé")] * rng.randrange(2)
        if w:
            words.append("".join(w))
    words_of, found = own.matches([" ".join(words)])
    assert words_of == [len(words)]
    starts, at = {}, 0
    for w in words:
        starts[at] = w
        at += len(w) + 1
    got = {s: (k, e) for _, s, _, k, e in found}
    for s, w in starts.items():
        if any(w.startswith(t) for t in TERMS if not t.endswith("$")):
            assert got[s] == (TERMS.index("achlich"), 0)
            continue
        options = [(d, k) for k, t in enumerate(TERMS) if t.endswith("$") and (d := distance(w, t[:-1])) <= (len(t) - 1 >= tox.FUZZY_FROM)]
        assert (got.get(s) is not None) == bool(options), w
        if options:
            assert got[s] == min(options)[::-1], w


def test_stems_against_prefix_edit_distance():
    terms = ("idiot$", "achlich", "reeux", "bom", "achlor", "reeus$", "achtlos$")
    own = tox.Automaton(terms, edited_stems=True)
    rng = random.Random(5)
    words = ["achl1chkeit", "ahclichkeit", "achlic", "achlch", "bamente", "reeus"]
    for _ in range(6000):
        w = list(rng.choice(["achlichkeit", "achlorig", "reeuxion", "reeux", "bomente", "achtlos", "idiot", "other", "achl"]))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(min(len(w), 7) + 1)
            if rng.random() < 0.3:
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k : k + rng.randrange(2)] = [rng.choice("achliorexusbmt1é")] * rng.randrange(2)
        if w:
            words.append("".join(w))
    _, found = own.matches([" ".join(words)])
    got, at, hits = {s: (e, k) for _, s, _, k, e in found}, 0, 0
    for w in words:
        options = []
        for k, t in enumerate(terms):
            d = distance(w, t[:-1]) if t.endswith("$") else min(distance(w[:n], t) for n in range(len(w) + 1))
            if d <= (len(t.removesuffix("$")) >= tox.FUZZY_FROM):
                options.append((d, k))
        # An exact stem is taken as soon as it is read; no term lies below another.
        assert got.get(at) == min(options, default=None), w
        hits += bool(options) and min(options)[0] == 1 and not terms[min(options)[1]].endswith("$")
        at += len(w) + 1
    assert hits > 500


def test_edited_stems_score(spark):
    lexicon = tox.Lexicon(["achlich", "bom"], [[0.9] * 4] * 2, [0.8] * 2)
    texts = ["so eine achl1chkeit", "so eine ahclichkeit", "so eine bamente", "so eine achtung"]
    df = spark.createDataFrame([(i, t, "de", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.predicted for r in tox.toxicity(df, lexicon).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_several_texts_keep_their_places():
    own = tox.Automaton(TERMS)
    words, found = own.matches(["", "you idiot", "fine", "idiiot, scum!"])
    assert words == [0, 2, 1, 2]
    assert [(i, s, e, edits) for i, s, e, _, edits in found] == [(1, 4, 9, 0), (3, 0, 6, 1), (3, 8, 12, 0)]


def test_masked_letters():
    own = tox.Automaton(TERMS)
    words, found = own.matches(["id*ot cl0wn scum! idiot*** a*b"])
    assert words == [5] and [(s, e, edits) for _, s, e, _, edits in found] == [(0, 5, 1), (6, 11, 1), (12, 16, 0), (18, 23, 0)]


def test_pieces_change_nothing(monkeypatch):
    texts = ["one idiot two closers\nthree lsoer four", "", None, "scum " * 30 + "and the end"]
    whole = tox.findings(texts, TERMS)
    monkeypatch.setattr(tox, "CHUNK", 7)
    assert tox.findings(texts, TERMS) == whole and whole[0][0] == 7 and len(whole[3][1]) == 30


def test_context_tells_mention_from_use():
    assert tox.context("you idiot", 4, 9) == 1.0
    t = 'the word "idiot" is rude'
    assert tox.context(t, 10, 15) == tox.QUOTED
    t = "he said idiot twice"
    assert tox.context(t, 8, 13) == tox.QUOTED


def made(seed, n=900):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdefghklmnprstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    bad = ["idiot", "worthless", "pathetic", "moron"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if toxic := rng.random() < 0.2:
            for _ in range(2):
                words.insert(rng.randrange(60), rng.choice(bad))
        docs.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = made(7)
    copies = [(2000 + i, "quite ordinary words in this much copied text idiot " * 3 + f"no{i}", "en", "a", 0) for i in range(40)]
    df = spark.createDataFrame(docs + copies, SCHEMA)
    lab = spark.createDataFrame([x for x in labels if x[0] % 3] + [(2000 + i, 1) for i in range(40)], "doc_id long, toxic int")
    lexicon = tox.learn(df, lab)
    assert {"idiot$", "worthless$", "pathetic$", "moron$"} <= set(lexicon.terms) and "copied$" not in lexicon.terms
    got = {r.doc_id: r.predicted for r in tox.toxicity(df, lexicon).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert sum(got[i] == y for i, y in held) / len(held) > 0.97
    odd_ones = spark.createDataFrame([(1, "you are a wortless thing", "en", "a", 0), (2, 'the term "worthless" stands here', "en", "a", 0), (3, "a worthy thing", "en", "a", 0)], SCHEMA)
    assert {r.doc_id: r.predicted for r in tox.toxicity(odd_ones, lexicon).collect()} == {1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("make", [odd, cluttered])
def test_awkward_rows(spark, make):
    lexicon = tox.Lexicon(["idiot$"], [[0.9] * 4], [0.8])
    out = tox.toxicity(make(spark), lexicon)
    assert ids(out) == ALL_IDS and all(r.score == 0.0 and r.predicted == 0 for r in out.collect())
    assert tox.toxicity(make(spark), tox.Lexicon([], [], [])).count() == len(ALL_IDS)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (4, 0), (4, 1), (6, 1)], "doc_id long, toxic int")
    assert tox.learn(make(spark), labels).terms == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = tox.learn(empty(spark), none)
    assert lexicon.terms == [] and tox.toxicity(empty(spark), lexicon).count() == 0
    assert odd(spark).where(tox.score(lexicon)(F.col("text")) < 0.7).count() == len(ALL_IDS)
