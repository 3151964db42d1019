"""URL filters: base rules on host and path, and association rules that FP-growth mines from the labels those rules give.

URLs that a base rule judges are the labelled examples, blocked or allowed; no table labels pages otherwise. FP-growth mines all
frequent combinations of up to three of their tokens, whatever the number of tokens in all, on one URL, or of rules. A combination
becomes a rule for one verdict if that verdict's share among its examples is high, beats the share among all examples and that of every
smaller combination in it, if its examples come from several base rules, and if enough of all URLs that it would judge are examples. An
inverted index from token to rule finds the rules of the URLs that no base rule reaches; the one of the greatest lift judges.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import settle, spent

#: Base rules that are compiled into one expression; longer lists are refused.
MOST_RULES = 1000
#: Association rules: least share and number of examples, least share of the verdict, most tokens.
MIN_SHARE, MIN_COUNT, MIN_CONFIDENCE, MOST_TOKENS = 0.005, 5, 0.8, 3
#: Least lift over the verdict's share among all examples, least gain over each smaller combination, least share of examples among the URLs
#: that meet a rule: what is seldom labelled says little of the rest.
MIN_LIFT, MIN_GAIN, MIN_KNOWN = 1.25, 0.02, 1 / 3
#: Base rules that the examples of a rule's verdict have to come from: what only one of them labels repeats that rule on other hosts.
MIN_RULES = 2
#: Frequent tokens of an example up to which Spark's FP-growth, which makes combinations of every size, mines all of them: at most 2^12
#: of one URL. Where an example has more, _grown() finds the same combinations size by size.
MOST_ITEMS = 12
#: Rules that one expression looks for; more take several passes over the URLs.
MOST_INDEX = 5000


@dataclass(frozen=True)
class Rule:
    """URLs with all these tokens get this verdict; confidence and lift are its share among examples, and that over the share among all."""

    tokens: frozenset[str]
    verdict: str
    confidence: float
    lift: float
    examples: int
    urls: int


def host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    h = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ? or # or the end; empty for null or without ://."""
    before = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", before)
    return F.when(at > 0, before.substr(at, F.length(before))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def base_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits. rules: (verdict, host/path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} base rules; one expression takes {MOST_RULES}")
    name = verdict = None
    for says, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        its_host, slash, rest = rule.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels, words of hyphenated labels, path parts, query names; digits count as one token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.concat_ws(".", F.filter(F.split(host, r"\."), lambda x: x.contains("-"))), r"[.\-]"), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.split(path, "[/.]"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.filter(F.array_distinct(F.concat(labels, words, parts, names)), lambda x: F.length(x) > 2)


def prepared(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, known (the base verdict, null if no rule fits), tokens of every page, written down."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"))
    p = p.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = base_rule(rules, F.col("host"), F.col("path"))
    return settle(p.select("page_id", "host", "path", name.alias("rule"), verdict.alias("known"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")), "urls")


def mine(p: DataFrame) -> list[Rule]:
    """Rules from the rows of prepared() (tokens, known, rule), the more lifting first: every combination that meets the bounds above.

    FP-growth deals its trees by item and merges equal rows before it sends them, so a hot host is a hot counter and not a hot
    task. What reaches the driver is the rules, MOST_INDEX combinations that may become rules, and, where no example has more than MOST_ITEMS
    frequent tokens, the frequent combinations, whose number the least share, those items and the most tokens bound.
    """
    labelled = p.where("known is not null")
    verdicts = {r.known: r.n for r in labelled.groupBy("known").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(verdicts.values())
    if len(verdicts) < 2 or not verdicts.keys() & {"block", "allow"}:
        return []
    share, least = {v: k / n for v, k in verdicts.items()}, max(MIN_COUNT, MIN_SHARE * n)
    by_token = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    most = int(MOST_ITEMS * n / least)  # more frequent tokens than this are more than MOST_ITEMS on some example
    vocabulary = [r.token for r in by_token.where(F.col("n") >= least).limit(most + 1).collect()]
    found = None
    if len(vocabulary) <= most:
        known = _lookup(dict.fromkeys(vocabulary, True), "boolean")
        items = labelled.select("known", F.filter("tokens", lambda t: known(t).isNotNull()).alias("items"))
        if (items.agg(F.max(F.size("items"))).first()[0] or 0) <= MOST_ITEMS:
            found = _whole(items, verdicts, least)
    rules = []
    for part in batched(_grown(labelled, verdicts, least) if found is None else found, MOST_INDEX):
        for (held, verdict), (urls, known, k, sources) in zip(part, _counted(p, part), strict=True):
            if sources >= MIN_RULES and known >= max(least, MIN_KNOWN * urls) and k >= max(MIN_CONFIDENCE, MIN_LIFT * share[verdict]) * known:
                rules.append(Rule(held, verdict, k / known, k / known / share[verdict], known, urls))
    return sorted(rules, key=_order)


def _order(r: Rule):
    return -r.lift, -r.confidence, r.verdict, sorted(r.tokens)


def _whole(items: DataFrame, verdicts: dict[str, int], least: float) -> Iterator[tuple[frozenset[str], str]]:
    """(tokens, verdict) of the combinations that may become rules, by Spark's FP-growth over all frequent tokens of the examples (items, known)."""
    n = sum(verdicts.values())
    marked = items.select(F.concat("items", F.array(F.upper("known"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=least / n * (1 - 1e-9)).fit(marked).freqItemsets
    frequent = {frozenset(r["items"]): r.freq for r in sets.where(F.size("items") <= MOST_TOKENS + 1).collect()}
    frequent[frozenset()] = n
    for s, k in frequent.items():
        for verdict in verdicts.keys() & {"block", "allow"}:
            mark = verdict.upper()
            if mark in s and len(s) > 1:
                held = s - {mark}
                sure = k / frequent[held]
                smaller = max(frequent.get((held - {t}) | {mark}, 0) / frequent[held - {t}] for t in held)
                if sure >= MIN_CONFIDENCE and sure >= MIN_LIFT * verdicts[verdict] / n and sure >= smaller + MIN_GAIN:
                    yield held, verdict


def _grown(labelled: DataFrame, verdicts: dict[str, int], least: float) -> Iterator[tuple[frozenset[str], str]]:
    """What _whole() gives, for examples of any number of frequent tokens: FP-growth size by size, its conditional bases written as tables.

    A combination can only become a rule for a verdict, or be part of one, if it has enough examples of it and if each of its tokens
    keeps out MIN_GAIN * least examples of other verdicts that the rest of it would let in. A rule s beats s without t by MIN_GAIN, so t keeps
    out that share of the examples of s without t, which are more than least; with fewer tokens beside it, t keeps out at
    least those. So combinations are dropped that no rule holds, and tokens that always come together never multiply.
    """
    says = sorted(verdicts.keys() & {"block", "allow"})
    numbers = ["n", *says]
    sums = [F.sum(c).alias(c) for c in numbers]
    alike = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("known") == v).alias(v) for v in says))
    written = [alike := settle(alike.withColumn("id", F.monotonically_increasing_id()), "examples")]
    of_token = alike.select(F.explode("tokens").alias("token"), *numbers).groupBy("token").agg(*sums).where(F.greatest(F.lit(0), *says) >= least)
    written.append(vocabulary := settle(of_token.orderBy(F.desc("n"), "token").withColumn("rank", F.monotonically_increasing_id()), "tokens"))

    # Level by level: held are the ranks of a combination, falling; before are the ranks that an example has below the last of them.
    nothing = F.array().cast("array<bigint>")
    every = labelled.sparkSession.range(1).select(nothing.alias("held"), F.lit(sum(verdicts.values())).alias("n"), *(F.lit(verdicts[v]).alias(v) for v in says), *(F.lit(True).alias(f"grows_{v}") for v in says))
    written.append(sets := settle(_growing(vocabulary.select(F.array("rank").alias("held"), *numbers), every, 1, says, least), "sets"))
    levels = [sets]
    useful = vocabulary.join(sets.select(sets["held"][0].alias("rank")), "rank").select("token", "rank")
    ranked = alike.select("id", *numbers, F.explode("tokens").alias("token")).join(useful, "token").groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("before"), *(F.first(c).alias(c) for c in numbers))
    written.append(bases := settle(ranked.groupBy("before").agg(*sums).withColumn("held", nothing), "bases"))
    for size in range(2, MOST_TOKENS + 1):
        opened = bases.select("held", "before", *numbers, F.posexplode("before").alias("at", "rank")).select(F.concat("held", F.array("rank")).alias("held"), F.slice("before", F.lit(1), F.col("at")).alias("before"), *numbers)
        counts = opened.select("held", F.explode("before").alias("rank"), *numbers).groupBy(F.concat("held", F.array("rank")).alias("held")).agg(*sums)
        written.append(sets := settle(_growing(counts, sets, size, says, least), "sets"))
        levels.append(sets)
        if size == MOST_TOKENS or sets.isEmpty():
            break
        mates = sets.groupBy(F.slice("held", 1, size - 1).alias("held")).agg(F.collect_list(F.element_at("held", size)).alias("mates"))
        kept = opened.join(mates, "held").select("held", F.array_intersect("before", "mates").alias("before"), *numbers).where(F.size("before") > 1)
        written.append(bases := settle(kept.groupBy("held", "before").agg(*sums), "bases"))

    n, good = sum(verdicts.values()), None
    for s in levels:
        for v in says:
            sure = F.col(v) / F.col("n")
            may = s.where((F.col(v) >= least) & (sure >= MIN_CONFIDENCE) & (sure >= MIN_LIFT * verdicts[v] / n) & (sure >= F.col(f"smaller_{v}") + MIN_GAIN)).select("held", F.lit(v).alias("verdict"))
            good = may if good is None else good.union(may)
    named = good.select("held", "verdict", F.explode("held").alias("rank")).join(vocabulary.select("rank", "token"), "rank").groupBy("held", "verdict").agg(F.collect_list("token").alias("tokens"))
    found = settle(named.select("tokens", "verdict"), "found")
    spent(*written)
    for r in found.toLocalIterator():
        yield frozenset(r.tokens), r.verdict
    spent(found)


def _growing(counts: DataFrame, smaller: DataFrame, size: int, says: list[str], least: float) -> DataFrame:
    """The combinations of this size that may be part of a rule, by their counts and those of the combinations smaller by one token.

    grows_ tells for which verdict, smaller_ the greatest share of the verdict in a smaller combination.
    """
    out = counts.where(F.greatest(F.lit(0), *says) >= least)
    for j in range(size):
        less = smaller.select(F.col("held").alias(f"held_{j}"), *(F.col(c).alias(f"{c}_{j}") for c in ("n", *says, *(f"grows_{v}" for v in says))))
        out = out.withColumn(f"held_{j}", F.concat(F.slice("held", 1, j), F.slice("held", j + 2, size))).join(less, f"held_{j}")
    for v in says:
        grows, before = F.col(v) >= least, []
        for j in range(size):
            kept_out = F.col(f"n_{j}") - F.col(f"{v}_{j}") - F.col("n") + F.col(v)
            grows = grows & F.col(f"grows_{v}_{j}") & (kept_out >= MIN_GAIN * least - 1e-6)
            before.append(F.col(f"{v}_{j}") / F.col(f"n_{j}"))
        out = out.withColumns({f"grows_{v}": grows, f"smaller_{v}": F.greatest(F.lit(0.0), *before)})
    grown = [f"grows_{v}" for v in says]
    return out.where(" or ".join(grown)).select("held", "n", *says, *grown, *(f"smaller_{v}" for v in says))


def _constant(value, kind: str) -> Column:
    """A literal of a nested type, folded once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lookup(values: dict[str, object], kind: str) -> Callable[[Column], Column]:
    """The value of a token, or null. Spark searches a map from end to end, so these are many small ones, by the token's crc32."""
    width = len(values) // 4 + 1
    parts: list[dict] = [{} for _ in range(width)]
    for t, v in values.items():
        parts[zlib.crc32(t.encode()) % width][t] = v
    maps = _constant(parts, f"array<map<string, {kind}>>")
    return lambda t: F.try_element_at(F.element_at(maps, (F.crc32(t) % width + 1).cast("int")), t)


def _met(p: DataFrame, rules: list[frozenset[str]]) -> DataFrame:
    """p with met, the numbers of the rules (MOST_INDEX at most) whose tokens a URL has. Under one token of each rule, its seldomest, the index holds the others."""
    spread: dict[str, int] = {}
    for s in rules:
        for t in s:
            spread[t] = spread.get(t, 0) + 1
    index: dict[str, list[dict]] = {}
    for i, s in enumerate(rules):
        first = min(s, key=lambda t: (spread[t], t))
        index.setdefault(first, []).append({"rest": sorted(s - {first}), "number": i})
    under = F.flatten(F.filter(F.transform("tokens", _lookup(index, "array<struct<rest:array<string>,number:int>>")), lambda x: x.isNotNull()))
    return p.withColumn("met", F.transform(F.filter(under, lambda r: F.forall(r["rest"], lambda t: F.array_contains("tokens", t))), lambda r: r["number"]))


def _counted(p: DataFrame, found: Iterable[tuple[frozenset[str], str]]) -> list[tuple[int, int, int, int]]:
    """(URLs, examples, examples of its verdict, base rules that gave those) of each rule over all URLs."""
    if not found:
        return []
    rows = _met(p, [s for s, _ in found]).select(F.explode("met").alias("number"), "known", "rule")
    verdicts = F.element_at(_constant([v for _, v in found], "array<string>"), F.col("number") + 1)
    own = F.col("known") == verdicts
    by_rule = rows.groupBy("number", "rule").agg(F.count(F.lit(1)).alias("urls"), F.count("known").alias("known"), F.count_if(own).alias("own"))
    got = by_rule.groupBy("number").agg(F.sum("urls").alias("urls"), F.sum("known").alias("known"), F.sum("own").alias("own"), F.count_if(F.col("own") > 0).alias("sources")).collect()
    counts = {r.number: (r.urls, r.known, r.own, r.sources) for r in got}
    return [counts.get(i, (0, 0, 0, 0)) for i in range(len(found))]


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Returns page_id, host, path, rule, verdict, mined, score for every row.

    A URL that no base rule fits gets the verdict of the rule of the greatest lift that it meets (then of the greatest
    confidence, then allow); mined tells that rule's tokens, score its confidence. Without one it is allowed, mined is null and score 0. A null
    URL or one without :// has an empty host and path, meets no rule and is allowed; repeated rows are judged alike; an empty table gives an
    empty result. URLs of any length are read whole.
    """
    return apply(p := prepared(pages, rules), mine(p))


def apply(p: DataFrame, mined: list[Rule]) -> DataFrame:
    """The result of judge() from the rows of prepared() and these rules, which come in the order in which they count.

    Each pass looks for MOST_INDEX of them, in that order, so what an earlier pass found stays.
    """
    kind = "struct<verdict:string,mined:string,score:double>"
    p = p.select("page_id", "host", "path", "rule", "known", "tokens", F.lit(None).cast(kind).alias("best"))
    last = None
    for i, part in enumerate(batched(sorted(mined, key=_order), MOST_INDEX)):
        if i:
            p = settle(p, "judged")
            if last:
                spent(last)
            last = p
        told = _constant([{"verdict": r.verdict, "mined": " ".join(sorted(r.tokens)), "score": r.confidence} for r in part], f"array<{kind}>")
        p = _met(p, [r.tokens for r in part])
        at = F.when(F.col("known").isNull(), F.array_min("met"))
        p = p.withColumn("best", F.coalesce("best", F.try_element_at(told, at + 1))).drop("met")
    return p.select("page_id", "host", "path", "rule", F.coalesce("known", "best.verdict", F.lit("allow")).alias("verdict"), F.col("best.mined").alias("mined"), F.coalesce("best.score", F.lit(0.0)).alias("score"))
