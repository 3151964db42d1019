"""Toxicity from a learned lexicon: a Levenshtein automaton intersected with the lexicon's trie, and context windows.

The lexicon is learned from a bounded sample of labelled documents: whole words, and stems that many words share. Its trie
and the automaton for one edit are multiplied out once, into one table of states; every word of every document then
walks through that table, all words of a chunk at the same time, a character at each step.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import chunks, pieces, settle, ship, sliced

#: Words and stems shorter than this are matched exactly only; a term's length in characters, from and to.
FUZZY_FROM, SHORTEST, LONGEST = 5, 3, 10
#: A term needs so many toxic documents in the sample that aren't copies of each other, and such a share of toxic ones.
SUPPORT, PRECISION = 5, 0.6
#: Borders of the share of matching words in a text; the weight of a match is learned for each range between them.
SHARES = (0.003, 0.008, 0.015)
#: Smallest word hashes by which copies among the toxic sample are told, and how many of them copies share.
SKETCH, ALIKE = 16, 8
#: Labelled rows that the lexicon is learned from, those of the smallest hash: the documented bound of the sample.
SAMPLE = 8192
#: Terms that are weighed against each other, those of most support: the documented bound of what reaches the driver.
CANDIDATES = 50_000
#: Signs that count as a letter between two letters, as they stand for one.
MASKS = "*@$#!"
#: Characters on either side of a match that its context score looks at, and what is left of a match in quotation.
WINDOW, QUOTED = 48, 0.5
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
REPORTING = ("said", "says", "called", "calls", "word", "term", "quote", "quoted", "wrote", "dijo", "sagte", "disait")
CHUNK = 1_000_000


@dataclass
class Lexicon:
    """terms: text, with a closing $ for a whole word; exact: P(toxic) of a text with the term, by range of SHARES; fuzzy: of one with an edited form."""

    terms: list[str]
    exact: list[list[float]]
    fuzzy: list[float]


class Automaton:
    """Deterministic table for: a word that is a term, starts with a stem, or is one edit (or two letters that changed places) from a whole-word term.

    With edited_stems, also a word that starts with an edited form of a stem: some prefix of it is one edit from the stem.
    """

    def __init__(self, terms: tuple[str, ...], edited_stems: bool = False):
        trie: list[dict[str, int]] = [{}]
        least = [len(terms)]  # the first term at or below a node
        whole: dict[int, int] = {}
        stem: dict[int, int] = {}
        edited: dict[int, int] = {}  # stems that edits are allowed for
        fuzzy: set[int] = {0}  # nodes on the way to a term that edits are allowed for
        for k, t in enumerate(terms):
            at, path = 0, [0]
            least[0] = min(least[0], k)
            for c in t.removesuffix("$"):
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                    least.append(k)
                at = trie[at][c]
                least[at] = min(least[at], k)
                path.append(at)
            if t.endswith("$"):
                whole[at] = k
                if len(t) - 1 >= FUZZY_FROM:
                    fuzzy.update(path)
            else:
                stem[at] = k
                if edited_stems and len(t) >= FUZZY_FROM:
                    fuzzy.update(path)
                    edited[at] = k
        long_enough = lambda node: len(terms[whole[node]]) - 1 >= FUZZY_FROM
        letters = sorted({c for n in trie for c in n})
        self.letters = {c: i + 2 for i, c in enumerate(letters)}  # class 0 parts words, 1 is any other letter

        def step(state: frozenset, c: str | None) -> frozenset | tuple:
            out = set()
            for node, e in state:
                if e == 3:  # the word starts with an edited form of this stem
                    out.add((node, e))
                    continue
                if e == 2:  # two letters changed places: the other one has to follow
                    node, other = node
                    out |= {(node, 1)} if c == other else set()
                    continue
                if (child := trie[node].get(c)) is not None and (e == 0 or child in fuzzy):
                    if e == 0 and child in stem:
                        return ("stem", stem[child])
                    out.add((child, e))
                if e == 0 and node in fuzzy:
                    out.add((node, 1))  # one letter too many
                    for letter, child in trie[node].items():
                        if child in fuzzy:
                            out.add((child, 1))  # another letter
                            if (skipped := trie[child].get(c)) is not None and skipped in fuzzy:
                                out.add((skipped, 1))  # a letter is missing
                                out.add(((skipped, letter), 2))
            begun = [n for n, e in out if e == 3]
            begun += [edited[n] for n, e in out if e == 1 and n in edited]
            begun += [edited[x] for n, e in out if e == 0 for x in trie[n].values() if x in edited]  # its last letter is missing
            first = min(begun, default=len(terms))
            if begun:  # of one edit each, the first term counts
                out = {(n, e) for n, e in out if e == 0 or (e < 3 and least[n[0] if e == 2 else n] < first)} | {(first, 3)}
            return frozenset((n, e) for n, e in out if not (e == 1 and (n, 0) in out))

        def ends(state) -> tuple[int, int]:
            """The term that a word ending in this state matches, and the edits."""
            if isinstance(state, tuple):
                return state[1], 0
            found = []
            for node, e in state:
                if e == 3:
                    found.append((1, node))
                if e < 2 and node in whole and (e == 0 or long_enough(node)):
                    found.append((e, whole[node]))
                if e == 0 and node in fuzzy:
                    found += [(1, whole[x]) for x in trie[node].values() if x in whole and long_enough(x)]
            e, k = min(found, default=(0, -1))
            return k, e

        # State 0 is dead.
        start = frozenset({(0, 0)})
        ids: dict = {frozenset(): 0, start: 1}
        todo, rows = [start], {0: [0] * (len(letters) + 2)}
        while todo:
            state = todo.pop()
            row = [0] * (len(letters) + 2)
            for cls, c in enumerate([None, *letters], 1):
                nxt = state if isinstance(state, tuple) else step(state, c)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row[cls] = ids[nxt]
            rows[ids[state]] = row
        self.start = 1
        self.next = np.array([rows[i] for i in range(len(ids))], np.int32)
        final = [ends(s) for s in ids]
        self.term = np.array([k for k, _ in final], np.int32)
        self.edits = np.array([e for _, e in final], np.int8)
        self.cls = np.zeros(0x110000, np.uint8)
        for first, end in _alphanumeric():
            self.cls[first:end] = 1
        for c, k in self.letters.items():
            self.cls[ord(c)] = k
        self.masks = np.zeros(0x110000, bool)
        self.masks[[ord(c) for c in MASKS]] = True
        if len(letters) > 253:
            raise ValueError("the lexicon has more than 253 different letters")

    def matches(self, texts: list[str]):
        """Words of each lower-case text; (text index, start, end, term, edits) of each word that matches."""
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.cls[code]
        cls[1:-1][self.masks[code[1:-1]] & (cls[:-2] > 0) & (cls[2:] > 0)] = 1
        inside = cls > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        starts, stops = edge[::2], edge[1::2]  # the closing line feed ends the last word
        state = np.full(len(starts), self.start, np.int32)
        end_state = np.zeros(len(starts), np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            state = self.next[state, cls[at]]
            at = at + 1
            done = at == stops[live]
            end_state[live[done]] = state[done]
            go = ~done & (state > 0)
            live, at, state = live[go], at[go], state[go]
        hit = np.flatnonzero(self.term[end_state] >= 0)
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        words = np.diff(np.searchsorted(starts, first)).tolist()
        of = np.searchsorted(first, starts[hit], "right") - 1
        return words, list(zip(of.tolist(), (starts[hit] - first[of]).tolist(), (stops[hit] - first[of]).tolist(), self.term[end_state[hit]].tolist(), self.edits[end_state[hit]].tolist(), strict=True))


@lru_cache(maxsize=1)
def _alphanumeric() -> list[tuple[int, int]]:
    """Ranges of code points that are letters or digits."""
    return [m.span() for m in re.finditer(r"[^\W_]+", "".join(map(chr, range(0x110000))))]


def context(text: str, start: int, end: int) -> float:
    """1 for a term that is used, QUOTED for one that is mentioned: in quotation marks, or after a reporting word."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    for opening, closing in QUOTES.items():
        if opening == closing:
            inside = left.count(opening) % 2 == 1 and closing in right
        else:
            inside = left.rfind(opening) > left.rfind(closing) and closing in right
        if inside:
            return QUOTED
    before = left.split()[-3:]
    return QUOTED if any(w.strip(".,:;") in REPORTING for w in before) else 1.0


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(terms, edited_stems=True)


def findings(texts: list[str | None], terms: tuple[str, ...]) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """The words of each text, and (term, edits, context) of each match in it."""
    out: list[tuple[int, list[tuple[int, int, float]]]] = []
    own = _automaton(terms)
    for a, b in chunks(texts, CHUNK):
        low = [(t or "").lower() for t in texts[a:b]]
        if b - a > 1:
            words, found = own.matches(low)
        else:
            words, found = [0], []
            for offset, piece in pieces(low[0], CHUNK):
                n, more = own.matches([piece])
                words[0] += n[0]
                found += [(0, s + offset, e + offset, term, edits) for _, s, e, term, edits in more]
        out += [(n, []) for n in words]
        for i, s, e, term, edits in found:
            out[a + i][1].append((term, edits, context(low[i], s, e)))
    return out


def shares(words: int, found: list[tuple[int, int, float]]) -> int:
    """The range of SHARES that the exact matches of a text fall in."""
    return bisect_right(SHARES, sum(w for _, e, w in found if not e) / max(1, words))


def _counted(sample: DataFrame) -> DataFrame:
    """Terms with the labelled documents that hold them: term, toxic, clean. sample: toxic, words."""
    words = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return words.select(_terms("word"), "toxic", "n").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _terms(word: str) -> Column:
    """A row for the whole word and one for each stem of it."""
    stems = F.when(F.length(word) >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(word), F.lit(LONGEST))), lambda n: F.substring(F.col(word), F.lit(1), n)))
    return F.explode(F.concat(F.array(F.concat(word, F.lit("$"))), F.coalesce(stems, F.array().cast("array<string>")))).alias("term")


def choose(support: dict[str, float], clean: dict[str, int]) -> list[str]:
    """Terms by what they gain, without stems and words of those already taken. support: toxic documents by word, copies counted once.

    A stem has to gain SUPPORT over the best of its whole words, else that word is the term.
    """
    word: dict[str, float] = {}
    for t in support:
        if t.endswith("$"):
            for n in range(SHORTEST, min(len(t) - 1, LONGEST) + 1):
                word[t[:n]] = max(word.get(t[:n], 0.0), support[t])
    terms: list[str] = []
    for t in sorted(support, key=lambda t: (support[t] - 2 * clean[t], t.endswith("$"), len(t), t), reverse=True):
        stem = t.removesuffix("$")
        if t == stem and support[t] < word.get(t, 0.0) + SUPPORT:
            continue
        within = any(x.startswith(stem) or (not x.endswith("$") and stem.startswith(x)) for x in terms)
        if not within and support[t] >= max(SUPPORT, PRECISION * (support[t] + clean[t])):
            terms.append(t)
    return terms


def families(sketches: dict[int, list[int]]) -> dict[int, int]:
    """A number for each document that its copies share: the first one whose sketch has ALIKE hashes of its own, or half of a short one."""
    by_hash: dict[int, list[int]] = {}
    out: dict[int, int] = {}
    for d, hashes in sorted(sketches.items()):
        shared: dict[int, int] = {}
        for h in hashes:
            for other in by_hash.get(h, ()):
                shared[other] = shared.get(other, 0) + 1
        like = [o for o, k in shared.items() if k >= min(ALIKE, len(hashes) / 2)]
        out[d] = min(like, default=d)
        if not like:
            for h in hashes:
                by_hash.setdefault(h, []).append(d)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Lexicon:
    """The lexicon of a sample of at most `sample` rows of labels (doc_id, toxic), those of the smallest hash.

    Rows without a label or an id take no part, and copies of a text count by the smallest id; without any toxic row the lexicon is
    empty. What reaches the driver is bounded by the sample and by CANDIDATES: sketches of its toxic documents, counts by term, and how
    often each term of the lexicon matches.
    """
    ship(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = settle(texts.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("first.*", "text"), "sample")
    worded = picked.select("doc_id", "toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("words")).withColumn("words", F.filter("words", lambda w: F.length(w).between(2, 40)))
    sketch = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, SKETCH)
    family = families({r.doc_id: r.sketch for r in worded.where("toxic = 1").select("doc_id", sketch.alias("sketch")).collect()})
    if not family:
        return Lexicon([], [], [])
    kinds = docs.sparkSession.createDataFrame(list(family.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, family {docs.schema['doc_id'].dataType.simpleString()}")
    rated = _counted(worded).where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * F.col("n")))
    held = worded.where("toxic = 1").select("doc_id", F.explode("words").alias("word")).select("doc_id", _terms("word")).distinct()
    by_term = held.join(F.broadcast(kinds), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("own"), F.count_distinct("family").alias("kinds")).where(F.col("kinds") >= SUPPORT)
    # A stem counts once for each of its words in a document, on either side; copies count as one document.
    weighed = by_term.join(rated, "term").select("term", (F.col("toxic") * F.col("kinds") / F.col("own")).alias("support"), (F.col("n") - F.col("toxic")).alias("clean"))
    rows = weighed.orderBy((F.col("support") - 2 * F.col("clean")).desc(), "term").limit(CANDIDATES).collect()
    support, clean = {r.term: r.support for r in rows}, {r.term: r.clean for r in rows}
    if not (terms := choose(support, clean)):
        return Lexicon([], [], [])
    key = tuple(terms)

    def matched(batches):
        for b in batches:
            rows = []
            scanned = (x for part in sliced(b.column(1)) for x in findings(part, key))
            for y, (words, found) in zip(b.column(0).to_pylist(), scanned, strict=True):
                # The uses of terms, or the edited forms in a text without any.
                edits = int(all(e for _, e, _ in found))
                rows += [(k, edits, shares(words, found), y) for k in sorted({k for k, e, _ in found if e == edits})]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int32()) for i, c in enumerate(("term", "edits", "share", "toxic"))})

    seen = {}
    for r in picked.select("toxic", "text").mapInArrow(matched, "term int, edits int, share int, toxic int").groupBy("term", "edits", "share").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect():
        seen[r.term, r.edits, r.share] = r.toxic, r.n

    def rate(k: int, edits: int, share: int, prior: float, weight: float) -> float:
        y, of = seen.get((k, edits, share), (0, 0))
        return (y + prior * weight) / (of + weight)

    priors = [(support[t] - 1) / (support[t] + clean[t] + 1) for t in terms]  # cautious: a chance word has few uses
    return Lexicon(terms, [[rate(k, 0, s, p, 2) for s in range(len(SHARES) + 1)] for k, p in enumerate(priors)], [rate(k, 1, 0, 0.8, 2.5) for k in range(len(terms))])


def score(lexicon: Lexicon):
    """A column function: toxicity of a text, 0 to 1; 0 for null, empty or clean texts."""
    terms, exact, fuzzy = tuple(lexicon.terms), lexicon.exact, lexicon.fuzzy

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        out = []
        for words, found in (x for part in sliced(text) for x in findings(part, terms)):
            share = shares(words, found)
            clean = 1 - max((w * exact[k][share] for k, e, w in found if not e), default=0.0)
            out.append(1 - clean * math.prod(1 - w * fuzzy[k] for k, w in {(k, w) for k, e, w in found if e}))
        return pa.array(out, pa.float64())

    return toxicity


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Returns doc_id, score, predicted (1 if score >= threshold) for every row.

    Texts of any length are read whole; null and empty texts score 0, repeated rows alike; rows with a null doc_id stay, and an empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", score(lexicon)(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
