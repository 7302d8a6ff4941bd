"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

Three steps per text:

1. Normalise by longest prefix through the model's compiled character map (a double-array trie over
   UTF-8 bytes whose leaves point into a pool of replacements), and record for every normalised
   byte the original byte it comes from.
2. Encode with the sentencepiece library.
3. Lay the pieces' lengths over the normalised bytes and project their ends through the alignment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from tickloom.llm.common import bounded_batches

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Fixed value of the model format: a piece that stands for one byte.
BYTE = 6

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: size, trie units, replacement pool.

    Fixed values of the format: in a trie unit the low byte is the label, bit 8 says that a value
    follows, bits 10 and up are the offset, shifted by 8 more if bit 9 is set; bit 31 marks a value.
    """

    def __init__(self, blob: bytes):
        self.units, self.pool = [], b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4: 4 + size], dtype="<u4").tolist()
            self.pool = blob[4 + size:]
        self.starts = self._children(0) if self.units else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _children(self, at: int) -> frozenset[int]:
        base = at ^ self._offset(self.units[at])
        return frozenset(c for c in range(1, 256) if base ^ c < len(self.units)
                         and self.units[base ^ c] & 0x800000FF == c)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that begins at ``at``, and its replacement."""
        units, found = self.units, None
        position = self._offset(units[0])
        for i in range(at, len(raw)):
            c = raw[i]
            position ^= c
            if position >= len(units) or units[position] & 0x800000FF != c:
                break
            unit = units[position]
            position ^= self._offset(unit)
            if unit & 0x100:
                value = units[position] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value: self.pool.index(b"\0", value)])
        return found


@dataclass
class Normalizer:
    """The library's normalisation with alignment: original byte of each normalised byte, and of the end."""

    map: CharacterMap
    dummy_prefix: bool
    squeeze: bool  # drop blanks at both ends, keep one of each run
    escape: bool  # write blanks as MARK
    suffix: bool  # the dummy blank goes to the end

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, dtype=np.int32)
        if not self.map.units and not self.squeeze and self.escape and self.dummy_prefix and not self.suffix:
            blank = np.frombuffer(raw, dtype=np.uint8) == 32
            widths = np.where(blank, 3, 1)
            source = np.concatenate([np.zeros(3, np.int32), np.repeat(np.arange(len(raw), dtype=np.int32), widths), [len(raw)]])
            return MARK_BYTES + raw.replace(b" ", MARK_BYTES), source.astype(np.int32)
        return self._by_rule(raw)

    def _units(self, raw: bytes):
        """(start, end, normalised bytes) of each maximal rule or plain character."""
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if raw[at] in self.map.starts else None
            if hit is None:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (size, raw[at: at + size])
            yield at, at + hit[0], hit[1]
            at += hit[0]

    def _by_rule(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        blank = MARK_BYTES if self.escape else b" "
        out, source = bytearray(), []
        after_blank, begun, end = self.squeeze, False, 0

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        for start, stop, piece in self._units(raw):
            if not begun:
                if self.squeeze and piece.strip(b" ") == b"":
                    end = stop
                    continue  # blanks before the text
                begun = True
                if self.dummy_prefix and not self.suffix:
                    put(blank, start)
            if after_blank:
                piece = piece.lstrip(b" ")
            for part in (piece[i: i + 1] for i in range(len(piece))):
                put(blank if part == b" " else part, start)
            if piece:
                after_blank = self.squeeze and piece.endswith(b" ")
            if piece.strip(b" ") or not self.squeeze:
                end = stop
        if self.squeeze:
            while out.endswith(blank) and len(out) >= len(blank):
                end = source[-len(blank)]
                del out[-len(blank):]
                del source[-len(blank):]
        if begun and self.dummy_prefix and self.suffix:
            put(blank, end)
        return bytes(out), np.array([*source, end if source else 0], dtype=np.int32)


class PieceCodec:
    """Encode and decode with one model; built once per Python worker."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.bytes_back = proto.trainer_spec.byte_fallback
        self.normalize = Normalizer(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix,
                                    spec.remove_extra_whitespaces, spec.escape_whitespaces,
                                    proto.trainer_spec.treat_whitespace_as_suffix)
        self.width = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int32)

    def encode_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        return self.library.encode(texts, num_threads=1, return_type="numpy") if texts else []

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte range of each piece."""
        normal, source = self.normalize(text)
        if self.bytes_back:
            widths = self.width[ids]
        else:  # an unknown piece is as long as what it stands for
            widths = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], dtype=np.int32)
        ends = np.cumsum(widths)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return source[ends - widths], source[ends]


_CODECS: dict[int, PieceCodec] = {}


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "encoded") -> DataFrame:
    """All columns of ``docs`` plus ``encoded``: struct(ids, starts, ends, decoded).

    ``ids`` are the library's for the whole text, without begin or end ids and without sampling; null
    text counts as empty and has no ids. starts and ends are byte positions in the UTF-8 text;
    several pieces may share them where one character was written as several bytes or a
    replacement. ``decoded`` is the library's text for the ids. Every row by itself; an input column
    named like the result is replaced. The model is read once and sent along with the task.
    """
    bounded_batches(docs.sparkSession, 500)
    with open(model_path, "rb") as f:
        model = f.read()

    @F.arrow_udf(ENCODED)
    def run(texts: pa.Array) -> pa.Array:
        key = hash(model)
        if key not in _CODECS:
            _CODECS[key] = PieceCodec(model)
        codec = _CODECS[key]
        values = [x or "" for x in texts.to_pylist()]
        ids = codec.encode_ids(values)
        spans = [codec.spans(x, i) for x, i in zip(values, ids)]
        decoded = codec.library.decode(ids, num_threads=1) if values else []
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))

        def lists(parts: list[np.ndarray]) -> pa.Array:
            flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))

        return pa.StructArray.from_arrays(
            [lists(ids), lists([s for s, _ in spans]), lists([e for _, e in spans]), pa.array(decoded, pa.string())],
            ["ids", "starts", "ends", "decoded"])

    return docs.withColumn(out, run(text))
