"""Personal data: base patterns as seeds, and contextual patterns that Spark bootstraps from them.

Seeds are the base matches, and secrets written as digests are. The one and two words before a seed are lexical patterns; what looks like
an identifier of any kind after the same words (mail forms, colon-hex, runs of digit groups, tokens with a digit) is an
instance. On the graph of patterns and instances, pattern confidence and instance score are computed in turns; confident
patterns then mark identifiers that no seed rule knows. Texts are read by narrow passes only; what is shuffled is the graph.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import fresh, settle, ship, sliced, spent

#: Kinds in their order, and their patterns. Possessive forms of the same languages, so that no text is scanned twice.
KINDS = ("email", "ip", "card", "phone")
#: A kind that only the method adds: its seeds are lower-case digests of the usual lengths, with a digit and a letter.
SECRET = "secret"
ALL = (*KINDS, SECRET)
DIGEST = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}(?:[0-9a-f]{8}|[0-9a-f]{32})?)(?![0-9A-Za-z])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What tokens with a digit are found by, and the signs around one that don't belong to an identifier.
DIGIT, REST, SIGNS = re.compile("[0-9]"), re.compile(r"\S*+"), ".,;:!?\"'()[]{}<>|*$#&%="
#: A numeric token with the brackets of its own, and what may stand between two of them in a run of digit groups.
GROUP, JOINS = re.compile(r"\+?\(?\+?[0-9]++(?:[().+/-]{1,3}+[0-9]++)*+\)?"), frozenset((" ", "\xa0", "\u202f", "\u2009", " - ", " – ", " / "))
#: Mail forms: the word between name and host where no sign is, what may stand before it, hosts, and a dot word that ends a part of a name.
AT, OPENING = re.compile(r"[aA][tT](?=[\s)\]}>])"), "([{<"
DOT = r"(?:\.|\s[dD][oO][tT]\s|\s?[(\[{<]\s?(?:[dD][oO][tT]|\.)\s?[)\]}>]\s?)"
HOST = re.compile(rf"[\w-]++(?:{DOT}[\w-]++)*+")
DOT_BEFORE = re.compile(rf"{DOT}\Z")
#: Colon-hex, with a zone; and what every such form holds.
HEX, PAIR = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,}+[0-9A-Fa-f]{0,4}(?:%\w++)?(?![\w:])"), re.compile(r":[0-9A-Fa-f]{0,4}:")
#: A longer instance is known by its hash in the graph; an instance's context is looked for in so many characters before it.
KEY, BEFORE = 256, 80
#: A pattern needs so many different seeds of its kind and such a share of all its instances; an instance such a score.
SUPPORT, CONFIDENCE, SCORE = 5, 0.8, 0.9
#: Turns end when no pattern is new and no confidence moves by more than this; more turns than the guard are an error.
MOVED, GUARD = 1e-4, 1000
#: Patterns that may be sent to every executor; with more, each text gets those of its own contexts by a join instead.
SENT = 100_000


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def tokens(text: str):
    """(start, end) of the runs without white space that hold a digit."""
    end = 0
    while m := DIGIT.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        yield start, (end := REST.match(text, m.start()).end())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in (m for s, e in tokens(text) if e - s >= 7 for m in IP.finditer(text, s, e)):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def seeds(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base matches, and the digests that none of them touches. Digests are looked for in long tokens with a digit only."""
    touched = _touching([(s, e) for _, s, e in base])
    found = [m.span() for s, e in tokens(text) if e - s >= 32 for m in DIGEST.finditer(text, s, e)]
    return base + [(SECRET, s, e) for s, e in found if not touched(s, e)]


def _touching(spans: list[tuple[int, int]]):
    """A function of start and end: whether any of these spans is touched. It bisects, so many spans cost little."""
    own = sorted(spans)
    starts, ends = [s for s, _ in own], list(accumulate((e for _, e in own), max))
    return lambda s, e: (k := bisect_left(starts, e)) > 0 and ends[k - 1] > s


def mail_forms(text: str) -> list[tuple[int, int]]:
    """Written-out or odd mail addresses: name, a sign or word for at, host. A bare word "at" needs a host with a dot."""
    out, last = [], 0
    marks = [m.span() for m in AT.finditer(text) if m.start() and (text[m.start() - 1].isspace() or text[m.start() - 1] in OPENING)]
    sign = text.find("@")
    while sign >= 0:
        marks.append((sign, sign + 1))
        sign = text.find("@", sign + 1)
    for first, to in sorted(marks):
        if first < last:
            continue
        stop, is_sign = first, to == first + 1
        spaced = stop > last and text[stop - 1].isspace()
        opened = stop - spaced - 1 >= last and text[stop - spaced - 1] in OPENING
        if opened:
            stop -= spaced + 1
            spaced = stop > last and text[stop - 1].isspace()
            to += text[to : to + 1].isspace()
            if text[to : to + 1] not in tuple(")]}>"):
                continue
            to += 1
            to += text[to : to + 1].isspace()
        elif is_sign:
            spaced = False
        else:
            to += 1
        if not (host := HOST.match(text, to)) or (not opened and not is_sign and not re.search(r"(?i)\.|dot", host[0])):
            continue
        stop -= spaced
        start = at = stop
        while True:
            while at > last and (text[at - 1].isalnum() or text[at - 1] in "._%+-"):
                at -= 1
            if at == stop:
                break
            start = at
            if not (dot := DOT_BEFORE.search(text, max(last, at - 9), at)):
                break
            stop = at = dot.start()
        if start < first and text[start : start + 1] not in ("", *"([{<@"):
            out.append((start, last := host.end()))
    return out


def others(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Instances that no seed touches, by start: mail forms, colon-hex, runs of digit groups, other tokens with a digit."""
    taken = [(s, e) for _, s, e in base]
    out: list[tuple[int, int]] = []
    touched = _touching(taken)
    forms = [x for x in mail_forms(text) if not touched(*x)]
    touched = _touching([*taken, *forms])
    if PAIR.search(text):
        hexes = [m.span() for m in HEX.finditer(text) if any(c not in ":%" for c in m[0]) and not touched(*m.span())]
        forms += hexes
        touched = _touching([*taken, *forms])
    run = -1  # the end of the run of digit groups that the last token is part of
    for begin, end in tokens(text):
        token = (raw := text[begin:end]).strip(SIGNS)
        s = begin + raw.index(token)
        e = s + len(token)
        if touched(s, e):
            run = -1
            continue
        at = s - (s > begin and text[s - 1] == "(")
        group = GROUP.match(text, at) if token[0] in "+0123456789" else None
        if not group or group.end() < e:
            out.append((s, e))
            run = -1
            continue
        if group[0].count("(") == group[0].count(")"):  # brackets of its own, as in (555) 010-1234
            s, e = group.span()
        if run >= 0 and text[run:s] in JOINS and token[0] != "+":
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
        run = e
    # Brackets around all of an instance are no part of it.
    return sorted([*forms, *((s + 1, e - 1) if text[s] == "(" and text.find(")", s, e) == e - 1 else (s, e) for s, e in out)])


def key(instance: str) -> str:
    """What an instance is known by in the graph."""
    return instance if len(instance) <= KEY else hashlib.sha256(instance.encode("utf-8", "surrogatepass")).hexdigest()


def contexts(text: str, start: int) -> list[str]:
    """The patterns before a position: one word, and two."""
    words = [w for w in text[max(0, start - BEFORE) : start].lower().split() if any(c.isalpha() for c in w)][-2:]
    return words[-1:] + [" ".join(words)] * (len(words) == 2)


SEEN = "array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"


def found_in(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and instances of a text: kind (null for an instance), start, end, what the graph knows it by, its patterns."""
    own = seeds(text, base)
    return [{"kind": k, "start": s, "end": e, "instance": key(text[s:e]), "patterns": contexts(text, s)} for k, s, e in [*own, *((None, *x) for x in others(text, own))]]


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts, written down: a row per document with doc_id, n_email, n_ip, n_card, n_phone, base_sha256, seen, _row.

    seen lists the seeds and instances with their contexts, which is all that bootstrap() and digest() need. A null text counts as
    empty; rows that repeat have rows of their own; texts are read whole, in time linear in their length.
    """
    ship(docs.sparkSession)
    seen_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in batches:
            n, sha, seen = [[] for _ in KINDS], [], []
            for t in (t or "" for part in sliced(b.column(1)) for t in part):
                base = base_spans(t)
                for counts, kind in zip(n, KINDS, strict=True):
                    counts.append(sum(k == kind for k, _, _ in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                seen.append(found_in(t, base))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(seen, seen_type)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "seen"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, seen {SEEN}")
    return settle(scanned.withColumn("_row", F.monotonically_increasing_id()), "seen")


def graph(scanned: DataFrame) -> DataFrame:
    """Edges (pattern, instance, kind): an instance, null kind if it is no seed, after the words of a pattern; each edge once."""
    seen = scanned.select(F.explode("seen").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.instance", "x.kind")
    return seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def bootstrap(scanned: DataFrame) -> DataFrame:
    """Confident patterns (pattern, kind, confidence), one kind each, from the rows of scan().

    Confidence is the summed score of a pattern's instances of its kind, over all its instances; copies of a text add no
    instance. An instance's score is that of all its confident patterns together, and its kind the one it was found as first.
    Confidence and score so never fall from turn to turn, and turns go on until no pattern and no instance is new and
    confidence stands still.
    """
    edges = settle(graph(scanned), "graph")
    found = before = None
    for _ in range(GUARD):
        scored = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
        if found is not None:
            scored = edges.join(found, "instance", "left").select("pattern", "instance", F.coalesce("kind", "as_kind").alias("kind"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("found_score", F.lit(0.0))).alias("score"))
        by_kind = [F.struct((F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) / F.count(F.lit(1))).alias("confidence"), F.count_if(F.col("kind") == k).alias("seeds"), F.lit(k).alias("kind")) for k in ALL]
        patterns = scored.groupBy("pattern").agg(F.greatest(*by_kind).alias("best")).select("pattern", "best.*").where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        patterns = settle(patterns.select("pattern", "kind", "confidence"))
        if before is None:
            changed = not patterns.isEmpty()
        else:
            was = before.select("pattern", F.col("confidence").alias("was"))
            changed = not patterns.join(was, "pattern", "left").where(F.col("was").isNull() | (F.abs(F.col("confidence") - F.col("was")) > MOVED)).isEmpty()
        if not changed:
            return patterns
        by_instance = edges.where("kind is null").select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind").agg(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))).alias("doubt"))
        if found is not None:
            first = found.select("instance", F.col("as_kind").alias("first"))
            by_instance = by_instance.join(first, "instance", "left").where("first is null or first = kind")
        found = settle(by_instance.select("instance", F.struct((1 - F.exp("doubt")).alias("found_score"), F.col("kind").alias("as_kind")).alias("s")).groupBy("instance").agg(F.max("s").alias("s")).select("instance", "s.*").where(F.col("found_score") >= SCORE))
        if found.isEmpty():
            return patterns
        if before is not None:
            spent(before)
        before = patterns
    raise RuntimeError(f"the patterns of personal data still change after {GUARD} turns")


def discovered(seen: list[dict], patterns: dict[str, tuple[str, float]]) -> list[tuple[str, int, int]]:
    """The instances among seen that the patterns mark, with their kinds."""
    out = []
    for x in seen if patterns else ():
        if x["kind"] is None:
            doubt: dict[str, float] = {}
            for kind, confidence in (patterns[p] for p in x["patterns"] if p in patterns):
                doubt[kind] = doubt.get(kind, 1.0) * (1 - confidence)
            if doubt and 1 - (least := min(doubt.values())) >= SCORE:
                out.append((min(k for k, v in doubt.items() if v == least), x["start"], x["end"]))
    return out


def all_spans(seen: list[dict], patterns: dict[str, tuple[str, float]]) -> list[tuple[str, int, int]]:
    """Seeds and what the patterns discover, by kind, then start."""
    return sorted([*((x["kind"], x["start"], x["end"]) for x in seen if x["kind"]), *discovered(seen, patterns)], key=lambda x: (ALL.index(x[0]), x[1], x[2]))


def marked(text: str | None, patterns: dict[str, tuple[str, float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans of a text."""
    text = text or ""
    base = base_spans(text)
    return base, all_spans(found_in(text, base), patterns)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _sent(patterns: DataFrame):
    """The patterns as a broadcast dictionary; None if they are too many for that."""
    rows = patterns.limit(SENT + 1).collect()
    return patterns.sparkSession.sparkContext.broadcast({r.pattern: (r.kind, r.confidence) for r in rows}) if len(rows) <= SENT else None


NEEDS = "array<struct<pattern:string,kind:string,confidence:double>>"


def _needed(needs) -> dict[str, tuple[str, float]]:
    return {x["pattern"]: (x["kind"], x["confidence"]) for x in needs or ()}


def digest(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans for every row of scan().

    spans are the base matches, digests and what the patterns discover. A null text has no spans; repeated rows come back alike.
    """
    sent = _sent(patterns)
    if sent is not None:
        rows = scanned.withColumn("needs", F.lit(None).cast(NEEDS))
    else:
        wanted = scanned.select("_row", F.explode("seen").alias("x")).where("x.kind is null").select("_row", F.explode("x.patterns").alias("pattern")).distinct()
        needs = wanted.join(patterns, "pattern").groupBy("_row").agg(F.collect_list(F.struct("pattern", "kind", "confidence")).alias("needs"))
        rows = scanned.join(needs, "_row", "left")

    def run(batches):
        for b in batches:
            spans = []
            for seen, needs in zip(sliced(b.column(0)), sliced(b.column(1)), strict=True):
                spans += [written(all_spans(x, sent.value if sent is not None else _needed(n))) for x, n in zip(seen, needs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(spans, pa.string())], [*told, "spans"])

    told = [c for c in scanned.columns if c not in ("seen", "_row")]
    types = ", ".join(f"{c} {scanned.schema[c].dataType.simpleString()}" for c in told)
    return rows.select("seen", "needs", *told).mapInArrow(run, f"{types}, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by <KIND>."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """docs with the personal data of text replaced, n_chars (if there) counting the new text; all other columns as they are.

    Null texts stay null, rows with null ids are masked like others, repeated rows alike; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    columns, sent, name = docs.columns, _sent(patterns), fresh("_needs", docs)
    if sent is not None:
        docs = docs.withColumn(name, F.lit(None).cast(NEEDS))
    else:  # equal texts need equal patterns, so texts are told by their own digest and not by any id

        def wants(batches):
            for b in batches:
                rows = [(i, p) for part, ids in zip(sliced(b.column(1)), sliced(b.column(0)), strict=True) for i, t in zip(ids, part, strict=True) for x in found_in(t, base_spans(t)) if x["kind"] is None for p in x["patterns"]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["text_sha", "pattern"])

        sha, own = F.sha2(F.col("text").cast("string"), 256), fresh("_text_sha", docs)
        texts = docs.where(F.col("text").isNotNull()).select(sha.alias("text_sha"), F.col("text").cast("string").alias("text"))
        wanted = texts.mapInArrow(wants, "text_sha string, pattern string").distinct()
        needs = wanted.join(patterns, "pattern").groupBy(F.col("text_sha").alias(own)).agg(F.collect_list(F.struct("pattern", "kind", "confidence")).alias(name))
        docs = docs.join(needs, sha == F.col(own), "left").drop(own)

    @F.arrow_udf("string")
    def hide(text: pa.Array, needs: pa.Array) -> pa.Array:
        out = []
        for texts, own in zip(sliced(text), sliced(needs), strict=True):
            out += [t and masked(t, marked(t, sent.value if sent is not None else _needed(n))[1]) for t, n in zip(texts, own, strict=True)]
        return pa.array(out, pa.string())

    out = docs.withColumn("text", hide(F.col("text").cast("string"), name))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)
