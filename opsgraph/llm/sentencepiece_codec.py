"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

For a merge-type vocabulary the encoding of every prefix of a string ends in one token only, and a token sequence is
the encoding of its string exactly when each adjacent pair is the encoding of its own concatenation.  So the table
keeps, for every prefix, that one last token: the automaton yields the pieces ending at the position, and the right
one is compatible with the last token of the prefix before it.  The ids are then read backwards from the end.

A piece has the separator mark only at its front, so text falls apart before each run of marks; units recur and are
kept in a table of bounded size.  No shuffle, no corpus state: rows map to rows.

Defined results: null and empty text give no ids and an empty decoded text; characters outside the vocabulary give
their UTF-8 bytes as byte pieces (or the unknown id where the model has none); text of any length is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_map

MARK = "▁"
#: Units kept by a worker; those that come later are encoded each time.
KEPT_UNITS, KEPT_PAIRS, KEPT_LENGTH = 400_000, 300_000, 48


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class _Units(dict):
    """Unit to its ids as packed int32."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, unit: str) -> bytes:
        packed = array("i", self._encode(unit)).tobytes()
        if len(self) < KEPT_UNITS and len(unit) <= KEPT_LENGTH:
            self[unit] = packed
        return packed


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        pieces, self._dummy = [], True
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part[1].decode(), float(np.frombuffer(part.get(2, b"\0" * 4), "<f4")[0]), part.get(3, 1)))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a merge-type model")
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models with a character map for normalising are not supported")
                if rules.get(4, 1):
                    raise ValueError("models that drop extra white space are not supported")
                self._dummy = bool(rules.get(3, 1))
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self._byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self._score = {p: score for p, score, kind in pieces if kind == 1}
        self._pieces = [p for p, _, _ in pieces]
        if any(MARK in p.lstrip(MARK) for p in self._score) or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("pieces with inner marks, and user-defined or unused ones, are not supported")
        self._match = ahocorasick.Automaton()
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1 and self._merge(p) == [p]:
                self._match.add_word(p, (i, len(p)))
        self._match.make_automaton()
        unit = {i: p.replace(MARK, " ").encode() for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        #: What a token decodes to: text, one byte, nothing for control tokens, a sign for the unknown one.
        self._bytes = [unit.get(i, b"") for i in range(len(pieces))]
        for value, i in self._byte.items():
            self._bytes[i] = bytes([value])
        self._bytes[self.unknown] = " ⁇ ".encode()
        #: Text also falls apart before and after the characters that stand alone in every piece.
        joined = set(chain.from_iterable(p for p in self._score if len(p) > 1))
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self._split = re.compile(rf"[{alone}]|" * bool(alone) + rf"{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self._pairs: dict[int, bool] = {}
        self._units = _Units(self._encode_unit)

    def _merge(self, text: str) -> list[str]:
        """The encoding by its definition: the best-scored adjacent pair is merged first, the leftmost of equals."""
        symbols, score = list(text), self._score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                got = score.get(symbols[i] + symbols[i + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their concatenation."""
        a, b = self._pieces[left], self._pieces[right]
        fits = self._merge(a + b) == [a, b]
        if len(self._pairs) < KEPT_PAIRS:
            self._pairs[left << 20 | right] = fits
        return fits

    def _encode_unit(self, unit: str) -> list[int]:
        n, pairs = len(unit), self._pairs
        last, back = [-2] * (n + 1), [0] * (n + 1)  # of each prefix: -2 has no piece at its end, -1 is the empty one
        last[0] = -1
        for end, (token, size) in self._match.iter(unit):
            end += 1
            if last[end] != -2:
                continue
            before = last[end - size]
            if before >= 0:
                fits = pairs.get(before << 20 | token)
                if not fits and (fits is False or not self._fits(before, token)):
                    continue
            last[end], back[end] = token, end - size
        ids, end = [], n
        while end:
            token = last[end]
            if token >= 0:
                ids.append(token)
                end = back[end]
            else:  # a character outside the vocabulary stands alone
                end -= 1
                ids.extend((self._byte[b] for b in reversed(unit[end].encode())) if self._byte else (self.unknown,))
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as int32, without begin or end."""
        if not text:
            return np.zeros(0, np.int32)
        marked = (MARK if self._dummy else "") + text.replace(" ", MARK)
        packed = map(self._units.__getitem__, self._split.findall(marked))
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark that encoding puts in front goes."""
        listed = ids.tolist()
        text = b"".join(map(self._bytes.__getitem__, listed)).decode("utf-8", "replace")
        return text[1:] if self._dummy and listed and self._pieces[listed[0]].startswith(MARK) else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, one per process."""
    if path not in _codecs:
        with open(path, "rb") as file:
            _codecs[path] = PieceCodec(file.read())
    return _codecs[path]


def encode_and_decode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) and ``decoded`` (the text that the ids give), row by row.

    ``model`` is a model file on the driver; it travels to the executors with the job.  Names in ``keep`` win nothing
    over ``ids`` and ``decoded``: a clash raises.
    """
    if {ids, decoded} & set(keep):
        raise ValueError(f"columns {ids} and {decoded} are made here")
    context = df.sparkSession.sparkContext
    context.addFile(model)
    name = model.rsplit("/", 1)[-1]

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        own = codec(SparkFiles.get(name))
        made = [own.encode(t or "") for t in texts.to_pylist()]
        offsets = np.zeros(len(made) + 1, np.int32)
        np.cumsum([len(x) for x in made], out=offsets[1:])
        flat = np.concatenate(made) if made else np.zeros(0, np.int32)
        return {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded: pa.array([own.decode(x) for x in made], pa.string())}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    schema = StructType([df.schema[k] for k in keep] + [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
    source = df.select(*keep, F.col(text).alias("__text"))
    return source.mapInArrow(column_map(convert, "__text", to_arrow_schema(schema), list(keep)), schema)
