import random

import pytest

from plinth.llm.tokencount import counter, token_counts
from tests.llm.fixtures import ALL_IDS, ROWS, cluttered, empty, ids, odd

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return counter(MODEL)


TEXTS = ["", " ", "a", "a b", "  a\n\nb\tc  d   ", "\x00a", "<s> x </s> <unk> <0x0A>", "a▁b ▁", "ａ１ 日本語 テスト 😀😀", "\r\n \n", "ab" * 900, "!" * 300, "aaaa " * 50, "internationalization of tokenizers"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_is_exact(own, text):
    text = text[:400]
    assert own.table(text) == [len(own.sp.encode(text[: i + 1])) for i in range(len(text))]


def test_random_texts(own):
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aeintrs  .\n▁éß0日😀{") for _ in range(rng.randrange(80)))
        assert own.count(text) == len(own.sp.encode(text)), text
        table, budget = own.table(text), rng.randrange(1, 30)
        assert own.cut(text, budget) == max([i + 1 for i, n in enumerate(table) if n <= budget], default=0), text


def test_long_texts_are_walked(own, monkeypatch):
    import plinth.llm.tokencount as m

    text = " many words in\n one  long text " * 40
    want, cut = len(own.sp.encode(text)), own.cut(text, 50)
    monkeypatch.setattr(m, "LONG", 10)
    assert own.count(text) == want and own.cut(text, 50) == cut


def test_rows(spark, own):
    got = token_counts(odd(spark), MODEL, limit=10).collect()
    want = sorted((repr(i), len((t or "").encode()), len(own.sp.encode(t or "")), len(own.sp.encode(t or "")) > 10) for i, t, *_ in ROWS)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert ids(token_counts(cluttered(spark), MODEL)) == ALL_IDS
    assert token_counts(empty(spark), MODEL).count() == 0


def test_full_tables_lose_no_count(own, monkeypatch):
    import plinth.llm.tokencount as m

    monkeypatch.setattr(m, "SEGMENTS", 3)
    monkeypatch.setattr(m, "PAIRS", 3)
    own.counts.clear()
    own.fits.clear()
    text = "many different words pass through two very small tables"
    assert own.count(text) == len(own.sp.encode(text))
