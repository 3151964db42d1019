"""Token counts by prefix dynamic programming.

For a merge tokenizer an encoding is right exactly when every two neighbouring tokens, joined and encoded alone, come out
as those same two tokens: no merge ever crosses their border. So the last token of each prefix is the one vocabulary piece
ending there that goes with the last token of the prefix before it, and the exact count of every prefix follows from left to
right, in time linear in the text. Truncation and budget questions read that table; nothing is encoded again.

Pieces never hold a space after another character, and line feeds are bytes of their own, so spaces and line feeds part the
text into segments whose counts add up. Segments repeat, and each worker keeps a bounded table of them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import ship

SPACE = "▁"
#: Segments and piece pairs that a worker keeps; a full table is emptied, which costs time and no result.
SEGMENTS, PAIRS, LONGEST_KEPT = 300_000, 1_000_000, 48
#: Texts longer than this aren't held as a list of segments.
LONG = 1_000_000
_SEGMENT = re.compile(r"[▁\n]+[^▁\n]*")


class PrefixCounter:
    """Exact token count of every prefix of a text, for a BPE model with byte fallback and a leading space."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = sp.get_piece_size()
        normal = [i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece.values()) or any("\n" in p for p in self.piece.values()):
            raise ValueError("pieces cross spaces or line feeds: segments of this model don't add up")
        self.known = {c for p in self.piece.values() for c in p}
        # A line feed is encoded as one byte and merges with nothing, so it shields what follows from the leading space.
        self.head = len(sp.encode("\n"))
        ends = ahocorasick.Automaton()
        for i, p in self.piece.items():
            if self.alone(p) == [i]:
                ends.add_word(p, (len(p), i))
        ends.make_automaton()
        self.ends = ends.iter
        self.foreign = re.compile("[^" + re.escape("".join(sorted(self.known))) + "]+")
        self.fits: dict[int, bool] = {}
        self.counts = _Counts(self)

    def alone(self, text: str) -> list[int]:
        return self.sp.encode("\n" + text)[self.head :]

    def run(self, text: str) -> list[int]:
        """Counts of the prefixes 1..n of a text of known characters."""
        last, count, fits = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.fits
        for end, (length, i) in self.ends(text):  # at each end the longest piece first
            end += 1
            if last[end] >= 0:
                continue
            if start := end - length:
                key = last[start] * self.n + i
                if (ok := fits.get(key)) is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    ok = fits[key] = self.alone(self.piece[last[start]] + self.piece[i]) == [last[start], i]
                if not ok:
                    continue
            last[end], count[end] = i, count[start] + 1
        return count[1:]

    def prefixes(self, segment: str) -> list[int]:
        """Counts of the prefixes 1..n of a segment; a character outside the vocabulary counts its UTF-8 bytes."""
        if not (odd := list(self.foreign.finditer(segment))):
            return self.run(segment)
        out: list[int] = []
        base = at = 0
        for m in odd:
            out += [base + c for c in self.run(segment[at : m.start()])]
            base = out[-1] if out else 0
            for c in m[0]:
                base += len(c.encode())
                out.append(base)
            at = m.end()
        return out + [base + c for c in self.run(segment[at:])]

    @staticmethod
    def segments(text: str):
        """The text with its leading space, parted before each run of spaces and line feeds; those of a long text one by one."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return _SEGMENT.findall(text) if len(text) <= LONG else (m[0] for m in _SEGMENT.finditer(text))

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.segments(text)))

    def table(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2], ... text[:n]."""
        out: list[int] = []
        base = 0
        for s in self.segments(text):
            out += [base + c for c in self.prefixes(s)]
            base = out[-1]
        return out[1:]  # without the leading space

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens, read from the prefix table of the segments."""
        best = base = at = 0
        for s in self.segments(text):
            # Counts inside a segment pass its end count by its length at most, and one segment lowers the count by none.
            if base <= budget:
                for k, c in enumerate(self.prefixes(s) if base + self.counts[s] > budget else (), 1):
                    if base + c <= budget:
                        best = at + k
            base += self.counts[s]
            at += len(s)
            if base <= budget:
                best = at
        return max(0, best - 1)


class _Counts(dict):
    def __init__(self, owner: PrefixCounter):
        super().__init__()
        self.owner = owner

    def __missing__(self, segment: str) -> int:
        n = self.owner.prefixes(segment)[-1]
        if len(segment) <= LONGEST_KEPT:
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = n
        return n


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    """One counter per worker process and model."""
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, over_limit, cut_chars for every row.

    cut_chars is the length in characters of the longest prefix with at most limit tokens. A null or empty text has 0
    bytes and 0 tokens; repeated rows and null ids come back as they are; a text of any length is counted whole. model is
    the path of a model file that every executor can read.
    """
    ship(docs.sparkSession)

    def run(batches):
        own = counter(model)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n, cut = [], []
            for t in texts:
                t = t.as_py()
                n.append(k := own.count(t))
                cut.append(own.cut(t, limit) if k > limit else len(t))
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), tokens, pc.greater(tokens, limit), pa.array(cut, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
