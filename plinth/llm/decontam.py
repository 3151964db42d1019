"""Benchmark decontamination: rare word n-grams seed, Smith-Waterman alignment decides.

Word frequencies over the whole corpus say which n-grams of the test items would hardly occur by chance. Those seeds are an
inverted index, held by every executor block of items by block; a document that meets one rare pair of an item's words, or two
rare triples, is aligned with it around them, if it has enough of its words there. The score is the alignment's part of what the whole item would score, so edited and paraphrased copies count by what
is left of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import chunks, pieces, ship, sliced

WORDS = re.compile(r"[^\W_]+")
#: Words of seeds, how often one may be expected at a place of a text by the frequencies of its words, and what a hit of it weighs. Two
#: neighbouring words in five or more are always left of what passes, as long as words are replaced and not only parted.
SEEDS = {3: (1e-6, 1), 2: (2e-5, 2)}
#: An item of one or two words counts only where they are as rare as this.
RARE = 1e-6
#: Alignment scores of equal words, of others and of gaps; least score of a contaminated document as a part of the whole item's.
EQUAL, OTHER, GAP = 2, -1, -1
THRESHOLD = 0.4
#: Weight of seeds that a place has to show, and words around them that are aligned besides the item's length.
HITS, AROUND = 2, 8
#: Items' words that are held at once; a larger benchmark takes several passes. Characters, seed hits and cells worked on at once.
HELD, CHUNK, POSTINGS, CELLS = 2_000_000, 1_000_000, 2_000_000, 4_000_000
#: Odd multipliers that tell seeds by a hash of their words; what equal hashes find besides, the alignment drops.
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Items:
    """Test items as word numbers, with the seeds of each."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in WORDS.findall((t or "").lower())], np.int64) for _, t in rows]

    def seed(self, counts: np.ndarray, total: int) -> None:
        """Choose the seeds by corpus counts of the items' words: rare n-grams, or all triples of an item that has too few rare ones."""
        p = np.log((counts + 1) / (total + 1))
        found: dict[int, list] = {1: [], 2: [], 3: []}  # by words: (codes, items, places, weight)
        self.least = np.full(len(self.words), HITS)
        for i, w in enumerate(self.words):
            if len(w) < 3:
                if len(w) and p[w].sum() <= np.log(RARE):
                    found[len(w)].append((_codes(w, len(w)), i, np.zeros(1, np.int64), HITS))
                continue
            weight = 0
            for width, (rare, each) in SEEDS.items():
                at = np.flatnonzero(sum(p[w[k : len(w) - width + 1 + k]] for k in range(width)) <= np.log(rare))
                found[width].append((_codes(w, width)[at], i, at, each))
                weight += each * len(at)
            if weight < HITS:
                found[3].append((_codes(w, 3), i, np.arange(len(w) - 2), 1))
                self.least[i] = min(HITS, len(w) - 2)
        self.tables = [_Seeds(width, own, len(self.words)) for width, own in found.items() if own]
        length = np.array([len(w) for w in self.words], np.int64)
        self.length, n = length, len(self.number) + 1
        flat = np.repeat(np.arange(len(length)), length) * n + np.concatenate([np.zeros(0, np.int64), *self.words])
        self.pair, self.times = np.unique(flat, return_counts=True)  # (item, word) and how often the item has it

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts (-1 for words of no item), and where each text's begin."""
        get, out, begin, at = self.number.get, [np.zeros(0, np.int64)], [0], 0
        for t in texts:
            for _, piece in pieces(t or "", CHUNK):
                found = [get(w, -1) for w in WORDS.findall(piece.lower())]
                at += len(found)
                out.append(np.array(found, np.int64))
            begin.append(at)
        return np.concatenate(out), np.array(begin)

    def hits(self, words: np.ndarray, begin: np.ndarray):
        """(text, item, diagonal, at, weight) of seed hits, in parts of about POSTINGS that hold all hits of a text and an item each."""
        held = []
        for t in self.tables:
            at, slot = t.lookup(words)
            text = np.searchsorted(begin, at, "right") - 1
            whole = at + t.width <= begin[text + 1]
            held.append((t, at[whole], slot[whole], text[whole]))
        per_text = np.zeros(len(begin), np.int64)
        for t, _, slot, text in held:
            per_text += np.bincount(text, t.first[slot + 1] - t.first[slot], minlength=len(begin)).astype(np.int64)
        for a, b in _ranges(per_text, POSTINGS):
            parts = -(-int(per_text[a:b].sum()) // POSTINGS) if b - a == 1 else 1
            edges = np.linspace(0, len(self.words), max(1, parts) + 1).astype(np.int64)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                found = [t.expand(at[here], slot[here], text[here], low, high) for t, at, slot, text in held if len(here := np.flatnonzero((text >= a) & (text < b)))]
                if found and sum(len(f[0]) for f in found):
                    text, item, diagonal, at, weight = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.lexsort((at, diagonal, item, text))
                    yield text[order], item[order], diagonal[order], at[order], weight[order]

    def candidates(self, hits, begin: np.ndarray, threshold: float = THRESHOLD, wide: bool = False):
        """(text, item, from, to) of the places to align: word ranges around seeds that lie near one diagonal; with wide, around
        seeds whose diagonals lie no further apart than an alignment at the threshold can pay for in gaps, and so many words more."""
        text, item, diagonal, at, weight = hits
        around = np.maximum(AROUND, np.ceil(EQUAL * self.length * (1 - threshold) / -GAP).astype(np.int64)) if wide else np.full(len(self.length), AROUND)
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > around[item[1:]])))
        group = np.cumsum(new) - 1
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
        span = begin[-1] + 1
        places = np.unique((group * span + at) * (HITS + 1) + weight)  # each seed at each place of a group once
        enough = np.bincount(places // ((HITS + 1) * span), places % (HITS + 1), minlength=len(first)) >= self.least[item[first]]
        first, last = first[enough], last[enough]
        low = np.maximum(diagonal[first] - around[item[first]], begin[text[first]])
        high = np.minimum(diagonal[last] + self.length[item[first]] + around[item[first]], begin[text[first] + 1])
        return np.stack((text[first], item[first], low, high), 1)

    def promising(self, found: np.ndarray, words: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the places that hold enough words of their item, in any order, to reach the threshold if all of them aligned."""
        keep = []
        n = len(self.number) + 1
        for a, b in _ranges(found[:, 3] - found[:, 2], CELLS):
            part = found[a:b]
            size = part[:, 3] - part[:, 2]
            which = np.repeat(np.arange(len(part)), size)
            word = words[np.repeat(part[:, 2] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            which, word = which[word >= 0], word[word >= 0]
            pair = np.unique(which * n + word)  # each word of a place once
            which, word = pair // n, pair % n
            asked = part[which, 1] * n + word
            slot = np.minimum(np.searchsorted(self.pair, asked), len(self.pair) - 1)
            there = self.pair[slot] == asked
            most = np.bincount(which[there], self.times[slot[there]], minlength=len(part))
            keep.append(part[most >= threshold * self.length[part[:, 1]] - 1e-9])
        return np.concatenate([found[:0], *keep])


def _codes(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words; the order of words counts."""
    n = len(w) - width + 1
    w = w.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = sum((w[k : n + k] * SPREAD[k] for k in range(width)), np.zeros(max(0, n), np.uint64))
        return (h ^ (h >> np.uint64(31))) * SPREAD[1]


def _ranges(sizes: np.ndarray, limit: int):
    """(first, last) ranges of entries whose sizes sum to at most limit, one entry at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


class _Seeds:
    """The inverted index of seeds of one width: code -> (item, place, weight), by item under each code."""

    def __init__(self, width: int, found: list, items: int):
        self.width, self.items = width, items
        code = np.concatenate([c for c, *_ in found])
        item = np.repeat([i for _, i, *_ in found], [len(c) for c, *_ in found]).astype(np.int64)
        order = np.lexsort((item, code))
        self.item, self.place = item[order], np.concatenate([p for _, _, p, _ in found])[order]
        self.weight = np.repeat([x for *_, x in found], [len(c) for c, *_ in found]).astype(np.int64)[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))
        self.by_item = np.repeat(np.arange(len(self.code)), np.diff(self.first)) * items + self.item  # ascends

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's words at which a seed begins, and the seed."""
        if len(words) < self.width or not len(self.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(words) - self.width + 1
        inside = np.logical_and.reduce([words[k : m + k] >= 0 for k in range(self.width)])
        code = _codes(words, self.width)[inside]
        slot = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        hit = self.code[slot] == code
        return np.flatnonzero(inside)[hit], slot[hit]

    def expand(self, at: np.ndarray, slot: np.ndarray, text: np.ndarray, low: int, high: int):
        """(text, item, diagonal, at, weight) of the hits on items from low to high; a diagonal is where the item would begin."""
        first, last = np.searchsorted(self.by_item, slot * self.items + low), np.searchsorted(self.by_item, slot * self.items + high)
        size = last - first
        post = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = np.repeat(at, size)
        return np.repeat(text, size), self.item[post], at - self.place[post], at, self.weight[post]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores (EQUAL, OTHER, GAP) of (item, passage) pairs of word numbers, all pairs at once, a row a step."""
    if not pairs:
        return np.zeros(0, np.int64)
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item = np.full((len(pairs), rows), -2, np.int32)
    text = np.full((len(pairs), width), -3, np.int32)
    for k, (a, b) in enumerate(pairs):
        item[k, : len(a)], text[k, : len(b)] = a, b
    h = np.zeros((len(pairs), width + 1), np.int32)
    best = np.zeros(len(pairs), np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    for i in range(rows):
        match = np.where(text == item[:, i : i + 1], EQUAL, OTHER)
        cell = np.zeros_like(h)
        cell[:, 1:] = np.maximum(np.maximum(h[:, :-1] + match, h[:, 1:] + GAP), 0)
        h = np.maximum.accumulate(cell + slope, axis=1) - slope  # the best gap in the passage that ends here
        best = np.maximum(best, h.max(axis=1))
    return best


def leaks(texts: list[str | None], items: Items, threshold: float) -> list[list[tuple[int, float, int, int]]]:
    """(item, score, first word, end word) of each item that a text holds to at least threshold, the best place of each."""
    out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
    for a, b in chunks(texts, CHUNK):
        words, begin = items.numbers(texts[a:b])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for hits, wide in ((h, w) for h in items.hits(words, begin) for w in (False, True)):
            found = items.promising(items.candidates(hits, begin, threshold, wide), words, threshold)
            # A wide place counts where it scores more than each narrow one in it, which tells better where the item is.
            narrow = dict(best) if wide else {}
            if wide:
                found = found[[narrow.get((int(c[0]), int(c[1])), (0.0,))[0] < 1 for c in found]] if len(found) else found
            order = np.argsort(found[:, 3] - found[:, 2], kind="stable")
            at = 0
            while at < len(order):
                part, cells = [], 0
                while at < len(order) and (not part or cells < CELLS):
                    part.append(found[order[at]])
                    cells = len(part) * (part[-1][3] - part[-1][2] + 1)
                    at += 1
                for (text, item, low, high), score in zip(part, align([(items.words[c[1]], words[c[2] : c[3]]) for c in part]).tolist(), strict=True):
                    share = score / (EQUAL * len(items.words[item]))
                    key = (int(text), int(item))
                    if share < threshold or (key in narrow and share <= narrow[key][0]):
                        continue
                    if key not in best or (share, -low) > (best[key][0], -best[key][1]):
                        best[key] = (share, int(low), int(high))
        for (text, item), (share, low, high) in sorted(best.items()):
            out[a + text].append((item, share, low - int(begin[text]), high - int(begin[text])))
    return out


def blocks(docs: DataFrame, benchmark: DataFrame, held: int = HELD):
    """Items of the benchmark with their seeds, a broadcast variable for each block of at most about held words.

    Blocks are read one at a time, and word counts come from all documents; items without words are none.
    """
    spark = docs.sparkSession
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = sized.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0  # WORDS, as Java writes it
    n = max(1, -(-total // held))
    for block in range(n):
        rows = [(r.item_id, r.text) for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()]
        items = Items([(i, t) for i, t in rows if WORDS.search(t)])
        sent = spark.sparkContext.broadcast(items)

        def count(batches, sent=sent):
            own = sent.value
            counts = np.zeros(len(own.number) + 1, np.int64)
            for b in batches:
                for texts in sliced(b.column(0)):
                    words, _ = own.numbers(texts)
                    counts += np.bincount(words + 1, minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at - 1, pa.int32()), pa.array(counts[at])], ["word", "n"])

        counts = np.zeros(len(items.number) + 1, np.int64)
        for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[r.word] = r.n  # -1, the words of no item, is the last
        items.seed(counts[:-1], int(counts.sum()))
        yield spark.sparkContext.broadcast(items)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Returns doc_id, item_id, score, first_word, end_word of every document (each row) that holds a test item to at least threshold.

    Score is 1 for a whole copy; words compare in lower case, without signs. Null, empty or wordless texts hold nothing. An item
    of one or two words is held only where these are rare (expected at most once in a million places of the corpus); an item that a text holds at several places is told at its best, then its
    first. With an empty table the result is empty.
    """
    ship(docs.sparkSession)
    out = None
    for sent in blocks(docs, benchmark):

        def run(batches, sent=sent):
            for b in batches:
                found = [f for part in sliced(b.column(1)) for f in leaks(part, sent.value, threshold)]
                rows = [(i, sent.value.ids[item], *rest) for i, f in enumerate(found) for item, *rest in f]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int32())), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                    ["doc_id", "item_id", "score", "first_word", "end_word"],
                )

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds a test item; all columns as they are. Rows with null or empty texts stay, an empty benchmark
    takes no row, and rows that repeat go or stay alike."""
    ship(docs.sparkSession)
    for sent in blocks(docs, benchmark):
        docs = docs.where(_clean(sent, threshold)(F.col("text").cast("string")))
    return docs


def _clean(sent, threshold: float):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([not f for part in sliced(text) for f in leaks(part, sent.value, threshold)], pa.bool_())

    return clean
