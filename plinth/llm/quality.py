"""Quality by nearest neighbours: latent-semantic vectors of labelled documents vote for every document.

A text's features are its character trigrams, as written in lower case and as shapes (case, digits, signs, repeated words), hashed to fixed
columns. A truncated singular value decomposition of a bounded labelled sample gives the latent axes; the sample's
vectors are broadcast, and each batch of documents is multiplied with them block by block, exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import chunks, pieces, ship, sliced

#: Columns of either kind of trigram, latent axes, neighbours that vote, and the sharpness of their weights.
COLUMNS, AXES, NEIGHBOURS, SHARPNESS = 1024, 64, 9, 12.0
#: Labelled rows that vote, those of the smallest hash: the documented bound of what is fitted and broadcast.
SAMPLE = 3072
CHUNK, BLOCK = 1_000_000, 512
#: Odd multipliers that spread trigrams over columns.
SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))

#: What parts words here.
_PARTING, _NEXT = "\0\n ", re.compile("[\0\n ]")
_shape: np.ndarray | None = None


def shape() -> np.ndarray:
    """Class of each code point: 1 lower case, 2 upper case, 3 digit, 4 space, 5 line feed, signs by themselves, 0 other."""
    global _shape
    if _shape is None:
        own = np.zeros(0x110000, np.uint8)
        for cp in range(0x30000):
            c = chr(cp)
            own[cp] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 1 if c.isalpha() else 0
        for i, c in enumerate(" \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t"):
            own[ord(c)] = 4 + i
        _shape = own
    return _shape


def shaped(code: np.ndarray) -> np.ndarray:
    """Classes of code points; those of a word that repeats the word before it are set apart."""
    own = shape()[code].astype(np.uint32)
    part = np.isin(code, (0, 10, 32))
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    if not part[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]  # the last code point is a zero
    if len(start) > 1:
        length = stop - start
        inside = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        chars = code[~part].astype(np.uint64)
        h = np.add.reduceat(chars * (2 * at.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD[0]) ^ chars << np.uint64(7), np.cumsum(length) - length)
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (length[1:] == length[:-1])))
        own[~part] += np.where(again[inside], np.uint32(64), np.uint32(0))
    return own


def features(texts: list[str | None]) -> np.ndarray:
    """Logarithmic counts of hashed trigrams, one row per text; a null or empty text has a row of zeros."""
    out = np.zeros((len(texts), 2 * COLUMNS), np.float32)
    for a, b in chunks(texts, CHUNK):
        if b - a > 1:
            out[a:b] = _counts([t or "" for t in texts[a:b]])
        else:
            out[a] = sum((_part(texts[a], at, at + len(p)) for at, p in pieces(texts[a] or "", CHUNK)), np.zeros(2 * COLUMNS))
    return np.log1p(out)


def _part(text: str, first: int, end: int) -> np.ndarray:
    """Counts of the trigrams that begin in a piece of a long text: it is read with the word before and the words that begin in the
    two characters after, so that the counts of all pieces are those of the whole text."""
    low, high = first, end
    while low and text[low - 1] in _PARTING:
        low -= 1
    while low and text[low - 1] not in _PARTING:
        low -= 1
    m = _NEXT.search(text, min(len(text), end + 2))
    high = m.start() if m else len(text)
    return _counts([text[low:high]], first - low, end - low)[0]


def _counts(texts: list[str], first: int = 0, end: int | None = None) -> np.ndarray:
    """Counts of trigrams by column; of a single text, those that begin from first to end."""
    out = np.zeros((len(texts), 2 * COLUMNS), np.float32)
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 4:
        return out
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in texts])
    low = np.frombuffer("\0".join([*(t.replace("\u0130", "i").lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (code[:-2] > 0) & (code[1:-1] > 0) & (code[2:] > 0)
    if end is not None:
        at = np.arange(len(inside))
        inside &= (at >= first) & (at < end)
    row = row[:-2][inside]
    for k, x in enumerate((low, shaped(code))):
        h = x[:-2] * SPREAD[0] + x[1:-1] * SPREAD[1] + x[2:] * SPREAD[2]
        h = ((h ^ (h >> np.uint32(15))) * SPREAD[1] >> np.uint32(22))[inside]
        out[:, k * COLUMNS : (k + 1) * COLUMNS] = np.bincount(row * COLUMNS + h, minlength=len(texts) * COLUMNS).reshape(len(texts), COLUMNS)
    return out


class Voters:
    """Latent axes, and the unit vectors and labels of the sample."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        self.labels = np.array(labels, np.float32)
        self.share = float(self.labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        x = features(texts)
        self.rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x = self.scaled(x)
        # The axes come from the small square product, so that the cost follows the columns and not the sample.
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :AXES]).astype(np.float32)
        self.vectors = self.unit(x @ self.axes)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return self.unit(x * self.rarity)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of good neighbours, weighted by similarity; ties go to the earlier voter. A text without trigrams has the share of good
        voters, and without any voter all have 0.5."""
        if not len(self.labels):
            return np.full(len(texts), self.share)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            own = features(texts[i : i + BLOCK])
            cosine = self.unit(self.scaled(own) @ self.axes) @ self.vectors.T
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, top, 1).min(1)
            for r in np.flatnonzero((cosine >= least[:, None]).sum(1) > k):  # ties for the last place
                top[r] = np.argsort(-cosine[r], kind="stable")[:k]
            top.sort(1)
            weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, top, 1) - 1)).astype(np.float64)
            out.append(np.where(own.any(1), (weight * self.labels[top]).sum(1) / weight.sum(1), self.share))
        return np.concatenate(out) if out else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 8, longest: int = 20_000) -> Voters:
    """Voters from at most `sample` labelled rows (doc_id, quality), those of the smallest hash among documents of at most
    `longest` characters, so that the driver's share is bounded. Exact copies vote once, by the smallest id; rows without id or label don't."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "quality")).alias("first")).orderBy("first").select("text", "first.quality").collect()
    return Voters([r.text for r in rows], [r.quality for r in rows])


def quality(docs: DataFrame, voters: Voters, threshold: float = 0.3) -> DataFrame:
    """Returns doc_id, score, predicted (1 if score >= threshold) for every row.

    Texts of any length are read whole; null and empty texts, and those under three characters, score the share of good voters, repeated rows
    alike, ties among neighbours in the order of the sample; rows with a null doc_id stay, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(voters)  # at most SAMPLE vectors and the axes

    def run(batches):
        for b in batches:
            score = np.concatenate([np.zeros(0), *(sent.value.score(part) for part in sliced(b.column(1), BLOCK))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
