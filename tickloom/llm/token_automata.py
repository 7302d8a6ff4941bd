"""Token counts by compiled finite-state machines.

A byte-level BPE file becomes two deterministic transducers.

1. The splitter reads code points, each with a symbol that holds its class and what follows it, and says before which of
   them a new pre-token begins. It has eight states. A text is cut into chunks of equal length; a chunk's state map
   (exit state of each entry state) is made without knowing how the chunk is entered, the maps are
   composed by a parallel prefix scan, and the states found so place the pre-tokens of all chunks at once.
2. The counter reads the bytes of a pre-token. A transition carries by how many tokens the encoding of the
   prefix grows (or shrinks). A state is what a continuation can depend on: the longest suffix that some longer token begins
   with, and for every position in it where such a suffix starts the last token of the encoding that ends there and its
   number of tokens. States are compiled when first reached; all pre-tokens of a block step together through one table.

That a prefix has one last token which fits the last token before it is the property of BPE both rest on: a sequence is an
encoding exactly if each two neighbours are the encoding of their joined bytes.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk, code points worked on at once, pre-tokens that step together.
CHUNK = 256
BLOCK_POINTS = 1 << 21
LANES = 1 << 14
#: The transition table has a row per state and a column per byte met; compiled states are forgotten beyond so many cells.
CELLS = 24 << 20
#: Fewer pre-tokens than this step one by one.
FEW = 24

#: Code point classes and the splitter's symbols.
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK_LAST, S_SPACE_LAST, S_INNER = range(8)
#: The splitter's states; NEW also follows a finished contraction.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, TWO_LEFT, ONE_LEFT = range(8)
#: Fixed values of the pre-tokenizer: what follows the apostrophe of a contraction.
CONTRACTIONS_SHORT = "stmd"
CONTRACTIONS_LONG = ("re", "ve", "ll")


def _split_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins before the symbol, by (state, symbol)."""
    to, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        to[state] = [IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_LEFT, TWO_LEFT, AFTER_BLANK, NEW, IN_SPACE]
    for state, symbol in ((IN_LETTERS, S_LETTER), (IN_NUMBERS, S_NUMBER), (IN_OTHER, S_OTHER), (IN_SPACE, S_INNER)):
        begins[state, symbol] = False
    for state in (IN_OTHER, AFTER_BLANK):  # here an apostrophe is one more sign
        to[state, [S_SHORT, S_LONG]] = IN_OTHER
        begins[state, [S_SHORT, S_LONG]] = False
    begins[AFTER_BLANK, [S_LETTER, S_NUMBER, S_OTHER]] = False
    to[TWO_LEFT], begins[TWO_LEFT] = ONE_LEFT, False
    to[ONE_LEFT], begins[ONE_LEFT] = NEW, False
    return to, begins


@functools.cache
def point_classes(spec: str) -> bytes:
    """Class of every code point, packed.

    The library's version of Unicode is not that of the modules here: where these two differ, the library is asked
    whether the point joins a letter or a digit.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for hit in regex.finditer(pattern, every):
            out[ord(hit.group()[0]): ord(hit.group()[-1]) + 1] = kind
    second = {"L": LETTER, "N": NUMBER}
    split = tokenizers.Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    for c in points:
        if out[c] != SPACE and second.get(unicodedata.category(chr(c))[0], OTHER) != out[c]:
            joins = [kind for sign, kind in (("a", LETTER), ("1", NUMBER)) if len(split(sign + chr(c))) == 1]
            out[c] = joins[0] if joins else OTHER
    out[32] = BLANK
    return zlib.compress(out.tobytes())


class Splitter:
    """Pre-token starts of many texts at once."""

    def __init__(self, classes: bytes) -> None:
        self.kind = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.to, self.begins = _split_table()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbol of each code point; ``ends`` marks the last one of a text."""
        kind = self.kind[points]
        white = kind >= BLANK
        solid_next = np.zeros(len(points), bool)
        solid_next[:-1] = ~white[1:]
        solid_next &= ~ends
        out = kind.copy()  # letters, numbers and signs keep their number
        out[white] = S_INNER
        out[(kind == BLANK) & solid_next] = S_BLANK_LAST
        out[(kind == SPACE) & solid_next] = S_SPACE_LAST
        at = np.flatnonzero((points == ord("'")) & ~ends)
        first = points[at + 1]
        out[at[np.isin(first, [ord(c) for c in CONTRACTIONS_SHORT])]] = S_SHORT
        keep = ~ends[at + 1]
        at, first = at[keep], first[keep]
        second = points[at + 2]
        for a, b in CONTRACTIONS_LONG:
            out[at[(first == ord(a)) & (second == ord(b))]] = S_LONG
        return out

    def starts(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point; ``lengths`` of the (non-empty) texts in a row."""
        stops = np.cumsum(lengths)
        ends = np.zeros(len(points), bool)
        ends[stops - 1] = True
        symbols = self.symbols(points, ends)
        # chunk table: where each begins, how long it is, whether it begins a text
        per_text = -(-lengths // CHUNK)
        first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
        n = int(per_text.sum())
        inside = np.arange(n) - np.repeat(first, per_text)
        begin = np.repeat(stops - lengths, per_text) + inside * CHUNK
        size = np.minimum(CHUNK, np.repeat(stops, per_text) - begin)
        order = np.argsort(-size, kind="stable")
        begin_o, size_o = begin[order], size[order]
        live = np.searchsorted(-size_o, -np.arange(1, CHUNK + 1), side="right")
        maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
        for t in range(int(size_o[0]) if n else 0):
            k = live[t]
            maps[:k] = self.to[maps[:k], symbols[begin_o[:k] + t][:, None]]
        placed = np.empty_like(maps)
        placed[order] = maps
        entry = self._scan(placed, inside == 0)
        state, out = entry[order], np.zeros(len(points), bool)
        for t in range(int(size_o[0]) if n else 0):
            k = live[t]
            at = begin_o[:k] + t
            out[at] = self.begins[state[:k], symbols[at]]
            state[:k] = self.to[state[:k], symbols[at]]
        return out

    @staticmethod
    def _scan(maps: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: maps composed over growing distances; a text's first chunk is entered as NEW."""
        done = maps.copy()
        done[opens] = maps[opens, NEW][:, None]  # whatever came before, so texts stay apart
        step = 1
        while step < len(done):
            earlier = done[:-step].copy()
            done[step:] = np.take_along_axis(done[step:], earlier, axis=1)
            step *= 2
        entry = np.full(len(maps), NEW, np.uint8)
        entry[1:] = done[:-1, NEW]
        entry[opens] = NEW
        return entry


class Counter:
    """Number of tokens of pre-tokens, by a transducer over bytes that is compiled as it is walked."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]) -> None:
        self.vocab, self.ranks = vocab, ranks
        self.begins = {token[:i] for token in vocab for i in range(len(token))}
        self.same = {token: token for token in vocab}  # one object for each token
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.table = np.full((256, 32), -1, np.int32)  # next state * 512 + growth + 256
        self.column = np.full(256, -1, np.int32)
        self.bytes_met: list[int] = []
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._number((b"", (b"",), (0,)))

    def _number(self, state: tuple) -> int:
        n = self.known.get(state)
        if n is None:
            n = self.known[state] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n

    def _meet(self, data: np.ndarray) -> None:
        """Columns for the bytes of a block that have none yet."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes_met)
                self.bytes_met.append(int(byte))
                if len(self.bytes_met) > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full((len(self.table), 32), -1, np.int32)], axis=1)

    def _full(self) -> bool:
        return len(self.states) * self.table.shape[1] > CELLS

    def _merge(self, raw: bytes) -> list[bytes]:
        parts = [raw[i: i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, last: bytes, token: bytes) -> bool:
        """Is (last, token) the encoding of its bytes?"""
        hit = self.fits.get((last, token))
        if hit is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            hit = self.fits[last, token] = self._merge(last + token) == ([last, token] if last else [token])
        return hit

    def _compile(self, number: int, column: int) -> int:
        """The transition of a state for one byte, entered in the table."""
        suffix, lasts, counts = self.states[number]
        grown = suffix + bytes([self.bytes_met[column]])
        for k, last in enumerate(lasts):  # from the longest token down
            token = self.same.get(grown[k:])
            if last is not None and token is not None and self._fit(last, token):
                break
        else:
            raise ValueError("a byte without token")
        growth = counts[k] + 1
        useful = [i for i in range(len(grown) + 1) if grown[i:] in self.begins]
        keep = useful[0]
        ends = dict.fromkeys(range(keep, len(grown) + 1))
        for i in useful:
            ends[i] = (token, 0) if i == len(grown) else (lasts[i], counts[i] - growth)
        state = (grown[keep:], tuple(e and e[0] for e in ends.values()), tuple(e and e[1] for e in ends.values()))
        step = self._number(state) * 512 + growth + 256
        self.table[number, column] = step
        return step

    def count(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens of a block that begin at ``starts``; equal ones are walked once."""
        raw, stops = data.tobytes(), [*starts[1:].tolist(), len(data)]
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(starts.tolist(), stops)], np.int64)
        sizes = np.array([len(x) for x in place], np.int64)
        flat = np.frombuffer(b"".join(place), np.uint8)
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(len(place), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), LANES):
            lanes = order[lo: lo + LANES]
            out[lanes] = self._walk(flat, begins[lanes], sizes[lanes])
        return out[which]

    def _walk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(starts)
        self._meet(data)
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            if live < FEW:
                for i, at in enumerate([self.states[k] for k in state[:live]]):  # by content, as numbers may change
                    total[i] += self._alone(at, data[starts[i] + t: starts[i] + sizes[i]].tobytes())
                break
            if self._full():
                state[:live] = self._restart([self.states[k] for k in state[:live]], data)
            column = self.column[data[starts[:live] + t]]
            step = self.table[state[:live], column]
            missing = np.flatnonzero(step < 0)
            if len(missing):
                pairs, where = np.unique(state[missing] * 256 + column[missing], return_inverse=True)
                step[missing] = np.array([self._compile(int(p) >> 8, int(p) & 255) for p in pairs], np.int32)[where]
            state[:live] = step >> 9
            total[:live] += (step & 511) - 256
        return total

    def _alone(self, at: tuple, raw: bytes) -> int:
        data = np.frombuffer(raw, np.uint8)
        self._meet(data)
        total, state = 0, self._number(at)
        for byte in raw:
            if self._full():
                state = self._restart([self.states[state]], data)[0]
            column = self.column[byte]
            step = int(self.table[state, column])
            if step < 0:
                step = self._compile(state, column)
            state = step >> 9
            total += (step & 511) - 256
        return total

    def _restart(self, live: list[tuple], data: np.ndarray) -> list[int]:
        """Forget all states but the ones in use, and number those anew."""
        self._clear()
        self._meet(data)
        return [self._number(state) for state in live]


def _byte_letters() -> dict[str, int]:
    """The letters a byte-level vocabulary file writes for bytes: printable Latin-1 signs as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class TokenCounter:
    """Both machines for one vocabulary file; counts as the library does with its defaults."""

    def __init__(self, spec: str, classes: bytes | None = None) -> None:
        classes = classes or point_classes(spec)
        spec = json.loads(spec)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) \
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normaliser, prefix blank and dropout is compiled")
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocab = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.counter = Counter(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.splitter = Splitter(classes)
        self.special = []
        for token in spec.get("added_tokens") or []:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens that strip or ask for word ends are not compiled")
            self.special.append(token["content"])
        self.pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token and parts the text."""
        out = np.zeros(len(texts), np.int64)
        owner, parts, held = [], [], 0
        for i, text in enumerate(texts):
            pieces = [text]
            if self.pattern is not None and any(s in text for s in self.special):
                pieces = self.pattern.split(text)
                out[i] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    owner.append(i)
                    parts.append(piece)
                    held += len(piece)
            if held >= BLOCK_POINTS:
                np.add.at(out, owner, self._block(parts))
                owner, parts, held = [], [], 0
        if parts:
            np.add.at(out, owner, self._block(parts))
        return out

    def _block(self, parts: list[str]) -> np.ndarray:
        lengths = np.array([len(p) for p in parts], np.int64)
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        begins = np.flatnonzero(self.splitter.starts(points, lengths))
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(widths) - widths
        tokens = self.counter.count(data, offset[begins])
        return np.add.reduceat(tokens, np.searchsorted(begins, np.cumsum(lengths) - lengths))


_MACHINES: dict[int, TokenCounter] = {}


def count_tokens(docs: DataFrame, spec_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` plus the number of tokens of the whole text (long).

    As the library counts them without begin, end or added special tokens, truncation or padding; a special string inside a
    text is one token. Null and empty texts have none. Every row by itself, so ties, repeated rows and empty tables need no
    care; an input column named like the result is replaced. The file is read once and sent along with the task; a worker
    keeps a table of at most CELLS numbers (96 MB) and works on about BLOCK_POINTS code points, or one text, at a time.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    classes = point_classes(spec)

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        key = hash(spec)
        if key not in _MACHINES:
            _MACHINES[key] = TokenCounter(spec, classes)
        return pa.array(_MACHINES[key].count([x or "" for x in texts.to_pylist()]), pa.int64())

    return docs.withColumn(out, run(text))
