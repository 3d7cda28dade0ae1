"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by backtracking.

Whether two neighbouring tokens may stand side by side depends on these two alone: merging
their joint text anew must give them back. A sequence whose neighbours all agree is the
sequence that merging the whole text would give. So the encoder walks from left to right,
takes the longest match at each place, falls back to shorter ones while the new token does
not agree with the one before, and steps back where none fits; a bit per position remembers
the places from which no way was found, so each is tried once.

Merging two tokens anew is not done symbol by symbol: each token was made by known merges, so
which symbols stood at its ends, and between which scores, is known, and the two disagree if
and only if a pair of such end symbols is a piece that is merged before either goes.
"""

from __future__ import annotations

from collections import Counter
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import only_memory, whole_text
from .pieces import BPE, BYTE, CONTROL, SPACE, UNKNOWN, PieceTable, read_model

#: Entries of a worker's memory, of which it has two in turn, and length of texts that it keeps.
MEMORY, MEMORY_CHARS = 200_000, 48
#: Bytes of texts that are cut into chunks at once, characters of a chunk that is walked together with others, pairs of tokens kept at hand.
TOGETHER, STEPS, PAIRS = 1 << 22, 64, 1 << 20
CHARS, CODE = 0x110000, 21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INFINITY = float("inf")


class Slots:
    """Whole numbers looked up by whole numbers, many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, 3 + len(keys).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        at, self.most = self.slot(keys), 0
        while len(keys):
            self.most += 1
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            keys, values, at = (np.delete(x, free) for x in (keys, values, at))
            at = (at + 1) % len(self.keys)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        rest = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for step in range(1, self.most):
            there = (at[rest] + step) % len(self.keys)
            held = self.keys[there]
            out[rest] = np.where(held == keys[rest], self.values[there], -1)
            rest = rest[(held != keys[rest]) & (held >= 0)]
            if not len(rest):
                break
        return out


class Encoder:
    def __init__(self, table: PieceTable):
        if table.model_type != BPE:
            raise ValueError("the model is not of the merge type")
        self.table = table
        self.score = {p: table.scores[i] for p, i in table.words.items()}
        self.valid, self.made = set(), {}  # of valid pieces, the two parts merged last
        for p in self.score:
            parts = self.merged(p, 2)
            if len(parts) <= 2:
                self.valid.add(p)
            if len(parts) == 2:
                self.made[p] = (parts[0], parts[1])
        # pieces whose scores do not tell their order: equal ones, and those not below their parts' scores
        times = Counter(s for p, s in self.score.items() if len(p) > 1)
        self.unordered = {p for p, s in self.score.items() if len(p) > 1 and times[s] > 1}
        for p in sorted(self.made, key=len):
            if any(x in self.unordered or x in self.made and self.score[x] <= self.score[p] for x in self.made[p]):
                self.unordered.add(p)
        self.matches = ahocorasick.Automaton()
        for p in self.valid:
            if len(p) > 1:
                self.matches.add_word(p, len(p) - 1)
        self.matches.make_automaton()
        self.ends: dict[str, list[tuple[str, float, float]] | None] = {}
        self.starts: dict[str, list[tuple[str, float, float]] | None] = {}
        self.prefix: dict[str, str] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.number()

    def number(self) -> None:
        """Numbers for tokens, of pieces first and of all characters behind them, and their tables."""
        table = self.table
        self.names = sorted(p for p in self.valid if len(p) > 1)
        self.base = base = len(self.names)
        number = {p: i for i, p in enumerate(self.names)}
        self.length, self.less = np.ones(base + CHARS, np.int16), np.full(base + CHARS, -1, np.int32)
        self.one = np.full(base + CHARS, -1 if table.byte_fallback else table.unknown, np.int32)  # the id; -1: several bytes
        if table.byte_fallback:
            self.one[base:base + 128] = table.byte_ids[:128]
        nodes, steps = {"": 0}, {}
        for p, i in number.items():
            shorter = self.shorter(p)
            self.length[i], self.less[i] = len(p), number[shorter] if len(shorter) > 1 else base + ord(shorter)
            for k, c in enumerate(p):
                steps[nodes[p[:k]] << CODE | ord(c)] = nodes.setdefault(p[:k + 1], len(nodes))
        for p, i in table.words.items():
            if p in number or len(p) == 1:
                self.one[number[p] if len(p) > 1 else base + ord(p)] = i
        self.final = np.array([number.get(p, -1) for p in nodes], np.int32)
        self.steps = Slots(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.pairs, self.apart = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

    def name(self, number: int) -> str:
        return self.names[number] if number < self.base else chr(number - self.base)

    def longest(self, codes: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of the longest token from each character on, which ends before ``stop``."""
        out = (codes + self.base).astype(np.int32)
        at, node, k = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            node = self.steps.find(node << CODE | codes[at + k])
            k += 1
            there = node >= 0
            at, node = at[there], node[there]
            final = self.final[node]
            out[at[final >= 0]] = final[final >= 0]
            inside = at + k < stop[at]
            at, node = at[inside], node[inside]
        return out

    def agree_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``agree`` for many pairs of numbered tokens."""
        pair = left.astype(np.int64) << CODE | right
        slot = (pair.astype(np.uint64) * MULTIPLIER).view(np.int64) & (1 << 62) - 1
        slot = (slot >> 30) % PAIRS
        out, new = self.apart[slot], np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            asked, which = np.unique(pair[new], return_inverse=True)
            some = np.array([self.agree(self.name(x >> CODE), self.name(x & (1 << CODE) - 1)) for x in asked.tolist()], bool)[which]
            out[new] = some
            self.pairs[slot[new]], self.apart[slot[new]] = pair[new], some
        return out

    def walk(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``split`` of many chunks in step: the numbers of their tokens one after the other, and how many each has."""
        stop = np.cumsum(sizes)
        first = stop - sizes
        longest = np.append(self.longest(codes, np.repeat(stop, sizes)), -1)
        made, failed, counts = np.zeros(len(codes) + 1, np.int32), np.zeros(len(codes) + 1, bool), np.zeros(len(sizes), np.int64)
        chunk, at, top = np.arange(len(sizes)), first.copy(), first.copy()
        last, token = np.full(len(sizes), -1, np.int32), longest[first]
        while len(chunk):
            end = at + self.length[token]
            fits = ~failed[end]
            asked = np.flatnonzero(fits & (last >= 0))
            fits[asked] = self.agree_all(last[asked], token[asked])
            made[top[fits]] = last[fits] = token[fits]
            top += fits
            at[fits] = end[fits]
            token = np.where(fits, longest[at], self.less[token])
            none = np.flatnonzero(~fits & (token < 0))
            while len(none):  # no token fits here: mark the place and step back
                if (top[none] == first[chunk[none]]).any():
                    raise ValueError("no sequence of agreeing tokens")
                failed[at[none]] = True
                top[none] -= 1
                undone = made[top[none]]
                at[none] -= self.length[undone]
                last[none] = np.where(top[none] > first[chunk[none]], made[top[none] - 1], -1)
                token[none] = self.less[undone]
                none = none[token[none] < 0]
            going = at < stop[chunk]
            if not going.all():
                counts[chunk[~going]] = (top - first[chunk])[~going]
                chunk, at, top, last, token = (x[going] for x in (chunk, at, top, last, token))
        return made[_ranges(first, counts)], counts

    def many_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks: all of them, and where those of each chunk begin and how many they are."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        short = sizes <= STEPS
        codes = np.frombuffer("".join(c for c in chunks if len(c) <= STEPS).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        tokens, counts = self.walk(codes, sizes[short])
        flat = self.one[tokens]
        lost = flat < 0
        if lost.any():
            raw = [chr(x - self.base).encode("utf-8") for x in tokens[lost].tolist()]
            long = np.ones(len(flat), np.int64)
            long[lost] = np.fromiter(map(len, raw), np.int64, len(raw))
            flat, lost = np.repeat(flat, long), np.repeat(lost, long)
            flat[lost] = np.array(self.table.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
            ends = np.cumsum(counts)
            long = np.append(0, np.cumsum(long))
            counts = long[ends] - long[ends - counts]
        others = [self.recalled(c, self.parts_ids) for c in chunks if len(c) > STEPS]
        sizes[short], sizes[~short] = counts, [len(x) for x in others]
        begin = np.zeros(len(chunks), np.int64)
        begin[short] = np.cumsum(counts) - counts
        begin[~short] = len(flat) + np.cumsum(sizes[~short]) - sizes[~short]
        return np.append(flat, np.array([i for x in others for i in x], np.int32)), begin, sizes

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Merges a short text, down to ``least`` parts: the best-scored pair first, the leftmost of equal ones."""
        parts, score = list(text), self.score
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.agreed.get(pair)
        if found is None:
            if len(self.agreed) >= MEMORY:
                self.agreed.clear()
            found = self.agreed[pair] = self.stay_apart(left, right)
        return found

    def spine(self, token: str, side: int) -> list[tuple[str, float, float]] | None:
        """(symbol, score that made it, score that took it) of the symbols at one end of a token; None if scores do not order them."""
        found, made, taken = [], self.made, -INFINITY
        if token in self.unordered:
            return None
        while True:
            born = self.score[token] if token in made else INFINITY
            found.append((token, born, taken))
            if token not in made:
                return found
            token, taken = made[token][side], born

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two tokens gives these two.

        Merges go by falling scores, on the left first where equal. A symbol at the end of
        ``left`` and one at the start of ``right`` are merged if they stand there at the same
        time and their piece comes before the merges that take them.
        """
        if left not in self.ends:
            self.ends[left] = self.spine(left, 1)
        if right not in self.starts:
            self.starts[right] = self.spine(right, 0)
        ends, starts, score = self.ends[left], self.starts[right], self.score
        if ends is None or starts is None:
            return self.merged(left + right) == [left, right]
        for x, x_born, x_taken in ends:
            for y, y_born, y_taken in starts:
                s = score.get(x + y)
                if s is not None and s > x_taken and s >= y_taken and x_born >= y_taken and y_born > x_taken:
                    return x + y in self.unordered and self.merged(left + right) == [left, right]
        return True

    def shorter(self, token: str) -> str:
        """Longest token that is a proper prefix; empty for a single character."""
        found = self.prefix.get(token)
        if found is None:
            found = next((token[:n] for n in range(len(token) - 1, 1, -1) if token[:n] in self.valid), token[:1])
            self.prefix[token] = found = "" if len(token) == 1 else found
        return found

    def split(self, text: str) -> list[str]:
        """Tokens of a text, as merging all of it would give them."""
        size = len(text)
        if size == 1 or text in self.valid:
            return [text]
        longest = [1] * size
        for end, back in self.matches.iter(text):  # ends ascend, so the longest comes last
            longest[end - back] = back + 1
        failed = bytearray()
        agreed, prefix = self.agreed, self.prefix
        tokens: list[str] = []
        at, last = 0, ""
        token = text[:longest[0]]
        while True:
            fits = not last or agreed.get((last, token))
            if fits is None:
                fits = self.agree(last, token)
            end = at + len(token)
            if fits and not (failed and failed[end >> 3] >> (end & 7) & 1):
                if end == size:
                    tokens.append(token)
                    return tokens
                tokens.append(token)
                last, at = token, end
                token = text[at:at + longest[at]]
                continue
            token = prefix[token] if token in prefix else self.shorter(token)
            while not token:  # no token fits here: mark the place and step back
                if not tokens:
                    raise ValueError("no sequence of agreeing tokens")
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                undone = tokens.pop()
                at -= len(undone)
                last = tokens[-1] if tokens else ""
                token = self.shorter(undone)

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        words, ids = self.table.words, []
        for token in self.split(chunk):
            i = words.get(token)
            if i is not None:
                ids.append(i)
            elif self.table.byte_fallback:
                ids.extend(self.table.byte_ids[b] for b in token.encode("utf-8"))
            else:
                ids.append(self.table.unknown)
        return tuple(ids)

    def ids(self, text: str) -> list[int]:
        out = []
        for chunk in self.table.chunks(text):
            out += self.known.get(chunk) or self.recalled(chunk, self.parts_ids)
        return out

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """``ids`` of many texts; each distinct chunk is looked up once."""
        if self.table.crossing:
            found = [self.ids(t.as_py()) for t in texts]
            return _lists(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32))
        numbers, chunks, each = self.table.numbered_chunks(texts)
        flat, begin, sizes = self.many_ids(chunks)
        long = np.append(0, np.cumsum(sizes[numbers]))  # of every chunk, as it stands in the texts
        return _lists(np.diff(long[np.append(0, np.cumsum(each))]), flat[_ranges(begin[numbers], sizes[numbers])])

    def parts_ids(self, chunk: str) -> tuple[int, ...]:
        """As ``chunk_ids``, cut where no piece holds the two neighbouring characters."""
        pairs, start, out = self.table.pairs, 0, []
        if pairs.issuperset(map(add, chunk, chunk[1:])):
            return self.chunk_ids(chunk)
        for i in range(1, len(chunk)):
            if chunk[i - 1:i + 1] not in pairs:
                out += self.recalled(chunk[start:i], self.chunk_ids)
                start = i
        out += self.recalled(chunk[start:], self.chunk_ids)
        return tuple(out)

    def recalled(self, chunk: str, work) -> tuple[int, ...]:
        """From memory, or worked out and remembered; what was not used for long is forgotten."""
        ids = self.known.get(chunk) or self.before.get(chunk) or work(chunk)
        if len(chunk) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY:
                self.before, self.known = self.known, {}
            self.known[chunk] = ids
        return ids


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, .. of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _bytes_text(raw: bytearray) -> str:
    """UTF-8 text; each byte that is part of no character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Decoder:
    def __init__(self, table: PieceTable):
        self.dummy_prefix = table.dummy_prefix
        self.surface: list[str] = []
        self.byte: dict[int, int] = {}
        for i, (piece, kind) in enumerate(zip(table.pieces, table.kinds, strict=True)):
            self.surface.append({CONTROL: "", BYTE: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(SPACE, " ")))
            if kind == BYTE:
                self.byte[i] = int(piece[1:-1], 16)
        raw = [bytes([self.byte[i]]) if i in self.byte else s.encode("utf-8") for i, s in enumerate(self.surface)]
        self.raw, self.first = pa.array(raw, pa.binary()), pa.array([i not in self.byte for i in range(len(raw))])

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """``text`` of many lists, null for null: their bytes one after the other, where all of these are UTF-8."""
        parts = pa.ListArray.from_arrays(ids.offsets, self.raw.take(ids.values), mask=ids.is_null() if ids.null_count else None)
        try:
            out = pc.binary_join(parts, b"").cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.text(x.values.to_pylist()) if x.is_valid else None for x in ids], pa.string())
        if not self.dummy_prefix:
            return out
        first = pc.list_element(pc.if_else(pc.greater(pc.list_value_length(ids), 0), ids, pa.scalar([0], ids.type)), 0)
        put = pc.and_(pc.starts_with(out, " "), self.first.take(first))
        return pc.if_else(put, pc.utf8_slice_codeunits(out, 1), out)

    def text(self, ids: list[int]) -> str:
        byte, surface = self.byte, self.surface
        if byte.keys().isdisjoint(ids):
            out = "".join(map(surface.__getitem__, ids))
            first = next((surface[i] for i in ids if surface[i]), "")
        else:
            parts: list[str] = []
            raw = bytearray()
            for i in ids:
                b = byte.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    parts.append(_bytes_text(raw))
                    raw = bytearray()
                parts.append(surface[i])
            if raw:
                parts.append(_bytes_text(raw))
            out = "".join(parts)
            first = next((p for p in parts if p), "") if ids[0] not in byte else ""
        return out[1:] if self.dummy_prefix and first.startswith(" ") else out


_ready: dict[tuple[type, bytes], object] = {}


def _of(kind: type, model: bytes):
    """Built once per worker process."""
    only_memory("bpe", _ready.clear)
    if (kind, model) not in _ready:
        _ready[kind, model] = kind(read_model(model))
    return _ready[kind, model]


def _encoded(texts: pa.Array, model: bytes) -> pa.ListArray:
    coder = _of(Encoder, model)
    cut = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
    cut = np.append(np.flatnonzero(np.append(True, cut[1:] != cut[:-1])[:len(cut)]), len(cut))
    return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(coder.lists(texts[a:b]) for a, b in zip(cut, cut[1:]))])


def encode(df: DataFrame, model: bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as array<int>.

    ``model`` holds the bytes of a SentencePiece model file of the merge type (about half a
    megabyte, of fixed size) and travels with the task. Null and empty texts have no ids;
    repeated rows are encoded alike; an existing column ``out`` is replaced.
    """
    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return _encoded(texts, model)

    return df.withColumn(out, ids(whole_text(text)))


def encode_and_decode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """As ``encode``, then ``decode``, in one function: two in a row would encode each text twice."""
    @F.arrow_udf(StructType([StructField("ids", ArrayType(IntegerType())), StructField("text", StringType())]))
    def coded(texts: pa.Array) -> pa.Array:
        found = _encoded(texts, model)
        return pa.StructArray.from_arrays([found, _of(Decoder, model).texts(found)], ["ids", "text"])

    both = coded(whole_text(text))
    return df.withColumns({ids: both["ids"], out: both["text"]})


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of token ids; null where the ids are null.

    Control ids give nothing, runs of byte pieces are read as UTF-8, and the space that
    encoding puts in front is taken off.
    """
    @F.arrow_udf(StringType())
    def texts(column: pa.Array) -> pa.Array:
        return _of(Decoder, model).texts(column)

    return df.withColumn(out, texts(F.col(ids)))
