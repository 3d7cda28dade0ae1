"""Token counts of unigram vocabularies without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic
programming keeps two numbers per character, the best score and the pieces on that path.
Ties follow the sentencepiece library: of equal candidates the piece that starts first wins,
sums within a word are rounded to 32-bit floats (whole-number scores need none), and a
character that no piece covers counts as unknown (its UTF-8 bytes, where the model falls
back to bytes). No piece holds a space mark after another character, so every path passes
each word boundary; words are counted alone and remembered.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import free_name, whole_text
from .pieces import PieceTable, read_model

MEMORY, MEMORY_CHARS = 400_000, 48
#: Below the lowest score by this much lies an unknown character (fixed value of the library).
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, table: PieceTable, floor: float = -math.inf):
        self.table = table
        scores = {p: float(np.float32(max(table.scores[i], floor))) for p, i in table.words.items()}
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = float(np.float32(min(scores.values(), default=0.0) - UNKNOWN_PENALTY))
        self.whole = all(s.is_integer() for s in [*scores.values(), self.unknown])
        self.matches = ahocorasick.Automaton()
        for p, s in scores.items():
            self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def _ends(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """(start, score, pieces) of what can end at each character, earliest start first."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in chunk]
        for end, (length, score) in self.matches.iter(chunk):
            ends[end].append((end + 1 - length, score, 1))
        for i, c in enumerate(chunk):
            ends[i].sort()
            if c not in self.single:
                ends[i].append((i, self.unknown, len(c.encode("utf-8")) if self.table.byte_fallback else 1))
        return ends

    def chunk(self, chunk: str) -> tuple[int, float]:
        """Pieces on the best path through a chunk, and its score."""
        best, count = [0.0], [0]
        for found in self._ends(chunk):
            top, pieces = None, 0
            for start, score, n in found:
                candidate = score + best[start]
                if not self.whole:
                    candidate = float(np.float32(candidate))
                if top is None or candidate > top:
                    top, pieces = candidate, count[start] + n
            best.append(top)
            count.append(pieces)
        return count[-1], best[-1]

    def count(self, text: str) -> tuple[int, float]:
        total, best, known = 0, 0.0, self.known
        for chunk in self.table.chunks(text):
            found = known.get(chunk)
            if found is None:
                found = self.chunk(chunk)
                if len(chunk) <= MEMORY_CHARS:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[chunk] = found
            total += found[0]
            best += found[1]
        return total, best


_ready: dict[tuple[bytes, float], Counter] = {}


def token_counts(df: DataFrame, model: bytes, floor: float = -math.inf, text: str = "text",
                 tokens: str = "n_tokens", score: str = "best_score") -> DataFrame:
    """Adds the number of tokens of each whole text and the score of the best path.

    ``model`` holds the bytes of a SentencePiece file whose scores are read as unigram
    scores (fixed size, it travels with the task); scores below ``floor`` are raised to it, for
    files that mark some pieces with a number far outside the range of the others. Null and empty texts have no tokens and
    score 0; repeated rows are counted alike; existing columns of these names are replaced.
    """
    kind = StructType([StructField("n", LongType()), StructField("s", DoubleType())])

    @F.arrow_udf(kind)
    def counted(texts: pa.Array) -> pa.Array:
        if (model, floor) not in _ready:
            _ready[model, floor] = Counter(read_model(model), floor)
        count = _ready[model, floor].count
        n, s = [], []
        for t in texts:
            a, b = count(t.as_py() or "")
            n.append(a)
            s.append(b)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["n", "s"])

    both = free_name(df, "_counted")
    return df.withColumn(both, counted(whole_text(text))).withColumns(
        {tokens: F.col(f"{both}.n"), score: F.col(f"{both}.s")}).drop(both)
