"""Reads the piece table of a SentencePiece model file."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
#: Fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at:at + size]
        at += size


@dataclass
class PieceTable:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True

    def __post_init__(self):
        self.words: dict[str, int] = {}
        self.pairs: set[str] = set()  # neighbouring characters inside pieces
        self.byte_ids = [0] * 256
        self.unknown = 0
        self.crossing = False

    def index(self) -> "PieceTable":
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == NORMAL:
                self.words[piece] = i
                self.pairs.update(piece[k:k + 2] for k in range(len(piece) - 1))
                self.crossing |= SPACE in piece.lstrip(SPACE)
            elif kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind != CONTROL:
                raise ValueError(f"piece {piece!r}: user-defined and unused pieces are not supported")
        return self

    def chunks(self, text: str) -> list[str]:
        """Spaces become marks; cut where no piece of the table can reach across.

        A cut stands before each run of marks, unless some piece holds a mark after
        another character; then the whole text is one chunk.
        """
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        return [text] if self.crossing else _CHUNK.findall(text)

    def numbered_chunks(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """``chunks`` of many texts, none null, if no piece is ``crossing``: numbers of all of them, the distinct ones, and how many each text has."""
        texts = pc.replace_substring(texts, SPACE, " ")
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        texts = texts.cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:ends[-1]]
        space = data == 32
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts[:ends[0]] = False
        at = np.flatnonzero(starts)
        spans = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, ends[-1]).astype(np.int32)), pa.py_buffer(data))
        spans = spans.dictionary_encode()
        return (spans.indices.to_numpy(), [c.replace(" ", SPACE) for c in spans.dictionary.to_pylist()],
                np.diff(np.searchsorted(at, ends)))


def read_model(data: bytes) -> PieceTable:
    """Piece table of the model file's bytes.

    Only the identity normaliser without white-space folding is understood; another one
    would need its character map and raises ValueError.
    """
    table = PieceTable()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            table.pieces.append(piece.get(1, b"").decode("utf-8"))
            table.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            table.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            table.model_type = trainer.get(3, UNIGRAM)
            table.byte_fallback = bool(trainer.get(35, 0))
            if trainer.get(24, 0):
                raise ValueError("white space as suffix is not supported")
        elif number == 3:
            norm = dict(_fields(value))
            table.dummy_prefix = bool(norm.get(3, 1))
            if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                raise ValueError("only the identity normaliser is supported")
    return table.index()
