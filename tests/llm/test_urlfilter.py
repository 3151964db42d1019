import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plinth.llm import urlfilter
from plinth.llm.queries import BASE_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url):
    host, path = parts(url)
    best = None
    for verdict, rule in BASE_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best or (None, None)


def urls():
    rng = random.Random(6)
    out = [None, "", "no scheme.example.com/en/", "http://", "http://?x", "HTTP://WWW.Example.COM/en/1", "http://example.com", "x://a.net/es/://b", "http://É.net/fr/x", "http://xnet/es/1", "http://net/es/", "a://b#c/d?e", "http://u@example.com:80/en/"]
    for _ in range(400):
        host = rng.choice(["", "www.", "m.", "a.b."]) + rng.choice(["example", "other", "Examples"]) + rng.choice([".com", ".net", ".org"])
        out.append(f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de', ''])}{rng.choice(['/', '', '?', '#'])}{rng.randrange(99)}")
    return out


def test_base_rules_against_plain_code(spark):
    data = list(enumerate(urls()))
    out = urlfilter.judge(spark.createDataFrame(data, "page_id long, url string"), BASE_RULES).collect()
    assert len(out) == len(data)
    for r in out:
        url = data[r.page_id][1]
        verdict, rule = judged(url)
        assert (r.host, r.path) == parts(url), url
        assert r.rule == rule and (verdict is None or (r.verdict, r.mined) == (verdict, None)), url


def plain_rules(rows):
    """The rules of (tokens, verdict or None) rows, by trying every combination."""
    known, source = [(t, v) for t, v in rows if v], {i: rule(i) for i in range(len(rows))}
    share = {v: sum(x == v for _, x in known) / len(known) for v in ("block", "allow")}
    least = max(urlfilter.MIN_COUNT, urlfilter.MIN_SHARE * len(known))
    every = sorted({t for own, _ in known for t in own})
    sure = lambda s, v: sum(x == v for t, x in known if s <= t) / max(1, sum(s <= t for t, _ in known))
    out = {}
    for k in range(1, urlfilter.MOST_TOKENS + 1):
        for s in map(frozenset, itertools.combinations(every, k)):
            for v in share:
                if sum(s <= t and x == v for t, x in known) < least:
                    continue
                c = sure(s, v)
                total, labelled = sum(s <= t for t, _ in rows), sum(s <= t for t, _ in known)
                if c >= max(urlfilter.MIN_CONFIDENCE, urlfilter.MIN_LIFT * share[v]) and all(c >= sure(s - {t}, v) + urlfilter.MIN_GAIN for t in s) and labelled >= urlfilter.MIN_KNOWN * total and len({source[i] for i, (t, x) in enumerate(rows) if s <= t and x == v}) >= urlfilter.MIN_RULES:
                    out[s, v] = (c, c / share[v], labelled, total)
    return out


def rule(i):
    return ("x/", "y/", "z/")[i * i % 7 % 3] if i % 5 else "x/"


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        own = frozenset(rng.sample(["h:p", "h:q", "p:r", "p:s", "w:t", "q:u", "w:v"], rng.randrange(1, 6)))
        says = "block" if {"h:p", "p:r"} <= own or {"w:t", "q:u"} <= own else "allow"
        if rng.random() < 0.05:
            says = "allow" if says == "block" else "block"
        rows.append((own, says if rng.random() < (0.1 if "w:v" in own else 0.7) else None))
    return rows


@pytest.mark.parametrize("seed", [8, 9])
def test_rules_and_verdicts_against_every_combination(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(i, "h", "/", None if v is None else rule(i), v, sorted(t)) for i, (t, v) in enumerate(rows)], "page_id long, host string, path string, rule string, known string, tokens array<string>")
    mined, want = urlfilter.mine(df), plain_rules(rows)
    got = {(r.tokens, r.verdict): (r.confidence, r.lift, r.examples, r.urls) for r in mined}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert any(len(s) == 2 and v == "block" for s, v in want)
    order = sorted(want, key=lambda x: (-want[x][1], -want[x][0], x[1], sorted(x[0])))
    for r in urlfilter.apply(df, mined).collect():
        own, known = rows[r.page_id]
        best = next((x for x in order if x[0] <= own), None)
        if known:
            assert (r.verdict, r.mined, r.score) == (known, None, 0.0)
        else:
            assert (r.verdict, r.mined) == ((best[1], " ".join(sorted(best[0]))) if best else ("allow", None))


@pytest.mark.parametrize("seed", [8, 9])
def test_rules_by_levels_and_in_many_passes(spark, monkeypatch, seed):
    monkeypatch.setattr(urlfilter, "MOST_ITEMS", 0)
    monkeypatch.setattr(urlfilter, "MOST_INDEX", 1)
    test_rules_and_verdicts_against_every_combination(spark, seed)


def frame(spark, rows):
    return spark.createDataFrame([(i, "h", "/", None if v is None else rule(i), v, sorted(t)) for i, (t, v) in enumerate(rows)], "page_id long, host string, path string, rule string, known string, tokens array<string>")


def test_no_token_of_a_long_url_is_dropped(spark):
    rng, rows = random.Random(3), []
    for _ in range(600):
        blocked, a = rng.random() < 0.5, rng.random() < 0.5
        both = {"q:x", "q:y"} if blocked and a else {rng.choice(["q:x", "q:y"])} if a else set()
        own = frozenset(both | {f"p:{k:02}" for k in range(14) if rng.random() < (0.9 if blocked else 0.5)})
        rows.append((own, ("block" if blocked else "allow") if rng.random() < 0.8 else None))
    assert max(len(t) for t, v in rows if v) > urlfilter.MOST_ITEMS
    mined, want = urlfilter.mine(frame(spark, rows)), plain_rules(rows)
    got = {(r.tokens, r.verdict): (r.confidence, r.lift, r.examples, r.urls) for r in mined}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert (frozenset({"q:x", "q:y"}), "block") in got


def test_no_frequent_token_is_dropped(spark):
    rows = [(frozenset({f"p:{(i + j * 61) % 240}" for j in range(4)}), "block") for i in range(1200)] + [(frozenset({"p:other"}), "allow")] * 1200
    bad = {f"p:{k}" for k in range(240)}
    mined = urlfilter.mine(frame(spark, rows + [(frozenset({t}), None) for t in sorted(bad)]))
    assert {t for r in mined for t in r.tokens} == bad | {"p:other"} and len(mined) == 241


def test_many_tokens_that_come_together_stay_small(spark):
    many = [f"q:{k}" for k in range(400)]
    rows = [(frozenset(many + ["p:bad"]), "block")] * 40 + [(frozenset(many), "allow")] * 10 + [(frozenset({"p:good"}), "allow")] * 40 + [(frozenset(["p:bad"]), None)] * 9
    mined = urlfilter.mine(frame(spark, rows))
    assert {(r.tokens, r.verdict) for r in mined if "p:bad" in r.tokens} == {(frozenset({"p:bad"}), "block")}
    assert len(mined) == 402 and all(len(r.tokens) == 1 for r in mined)  # 400 names at 0.8 for block, and p:good


def test_mined_rules_reach_other_hosts(spark):
    data = [(i, f"http://a{i}.{'com' if i % 3 else 'net'}/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)] + [(900, "http://x.org/bad/7"), (901, "http://x.org/good/7")]
    df = spark.createDataFrame(data, "page_id long, url string").withColumns({"tokens": F.lit(1), "index": F.lit(2), "items": F.lit(3), "rule": F.lit(4), "met": F.lit(5), "best": F.lit(6), "known": F.lit(7)})
    out = {r.page_id: r for r in urlfilter.judge(df, [("allow", "com/"), ("allow", "net/"), ("block", "com/bad/"), ("block", "net/bad/")]).collect()}
    assert (out[900].verdict, out[901].verdict, out[900].rule) == ("block", "allow", None)
    assert (out[900].mined, out[901].mined, out[900].score) == ("p:bad", "p:good", 1.0)
    one = {r.page_id: r for r in urlfilter.judge(df, [("allow", "com/"), ("allow", "net/"), ("block", "com/bad/")]).collect()}
    assert (one[900].verdict, one[900].mined) == ("allow", None)  # one base rule alone says nothing of other hosts


def test_a_repeated_url_of_many_tokens_stays_small(spark):
    deep = "/".join(f"part{chr(97 + k)}" for k in range(24))
    data = [(i, f"http://a.com/bad/{deep}" if i % 2 else f"http://b.com/good/{i}") for i in range(300)] + [(700 + i, f"http://a.net/bad/{deep}") for i in range(50)] + [(900, f"http://x.org/bad/{deep}"), (901, "http://y.org/" + "z/" * 40_000), (902, "http://y.org/bad?" + "&".join(f"k{j}=1" for j in range(3000)))]
    df = spark.createDataFrame(data, "page_id long, url string")
    out = {r.page_id: r for r in urlfilter.judge(df, [("allow", "com/"), ("block", "com/bad/"), ("block", "net/bad/")]).collect()}
    assert out[900].verdict == "block" and out[901].verdict == "allow" and len(out) == 353


def test_empty_and_unjudged(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none, BASE_RULES).count() == 0
    some = spark.createDataFrame([(None, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    assert [(r.verdict, r.mined) for r in urlfilter.judge(some, BASE_RULES).collect()] == [("allow", None)] * 3
