"""Phrase collocations by partitioning: mine shards completely, unite what is frequent in one, count the union exactly.

A phrase that stands ``min_count`` times in a language stands at least min_count / SHARDS times in one of SHARDS shards. So

1. every shard is mined with a part (one in SLACK) of that lowered support: first its words and pairs, then the phrases of
   three to five words all of whose pairs can be frequent. A shard may be larger than a task: its tasks count blocks of text,
   and a shuffle on (shard, hash) adds the blocks up. Hashes of 64 bits do here, as two phrases with one hash can only add a
   candidate;
2. the locally frequent phrases are united, without those that cannot reach min_count with the most the shards that do not
   name them can hold. The lower the support of the shards, the less that is, and the closer the union is to the result;
3. all texts are read once more and the phrases of the union counted, now by their words, and the counts summed.

Task memory is bounded by BLOCK_BYTES of text (or one text). The union reaches the tasks as a bitmap of hashes, sixteen bits or more
a phrase up to MOST_BITS in all. The bitmap only saves work: a phrase outside the union that slips through has less
than min_count and goes with the others that have. What is shuffled grows with the text, not with the square of anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

#: Shards; a partition of the input belongs to one by its number.
SHARDS = 8
#: Shards are mined with this part of the support at which a frequent phrase must show in one of them.
SLACK = 4
#: Bytes of text a task works on at once, and rows of an Arrow batch it gives back.
BLOCK_BYTES = 32 << 20
BATCH_ROWS = 1 << 18
LONGEST = 5
#: Most bits of the bitmap (128 MB), and bits of the blocks in which it is put together.
MOST_BITS = 1 << 30
BLOCK_BITS = 1 << 19
#: Fixed values of the contract: bytes that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"  # no byte of UTF-8
_TO_BREAK = bytes(_BREAK[0] if i in PIECE_ENDS else i for i in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text in order, with a break byte between pieces."""
    # bytes methods lower only A-Z; after the translation blank and tab are the only white space left
    return text.encode().lower().translate(_TO_BREAK).replace(_BREAK, b" \xff ").split()


class _Ids(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Block:
    """Words of some documents of one language as numbers; -1 stands between pieces and documents."""

    def __init__(self, lang: str, parts: list[np.ndarray], vocabulary: list[bytes], word_hash: np.ndarray) -> None:
        self.lang, self.vocabulary, self.word_hash = lang, vocabulary, word_hash
        self.row = np.concatenate(parts)
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def hashes(self, n: int, first: np.ndarray) -> np.ndarray:
        """Hash of the language and the n words from each position on."""
        return phrase_hash(self.seed, [self.word_hash[self.row[first + j]] for j in range(n)])

    def phrases(self, n: int, first: np.ndarray) -> list[str]:
        words = self.vocabulary
        return [b" ".join([words[i] for i in run]).decode() for run in self.row[first[:, None] + np.arange(n)].tolist()]

    def positions(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        whole = self.row >= 0
        if n == 2:
            whole = whole[:-1] & whole[1:]
        return np.flatnonzero(whole)

    def levels(self, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first position, count) of the distinct phrases that ``keep(words, positions)`` leaves, length by length.

        A phrase is only looked at where both phrases one word shorter were kept.
        """
        number = np.full(len(self.row), -1, np.int64)  # of the kept phrase of the present length that begins here
        for n in range(1, LONGEST + 1):
            if n == 1:
                at = self.positions(1)
                key = self.row[at]
            else:
                at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
                key = number[at] * (int(number.max(initial=0)) + 1) + number[at + 1]
            if not len(at):
                return
            _, first, place, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            first = at[first]
            good = keep(n, first)
            number[:] = -1
            number[at] = np.where(good, np.cumsum(good) - 1, -1)[place]
            yield n, first[good], count[good]


def phrase_hash(seed: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    mixed = np.full(len(words[0]), seed, np.uint64)
    for w in words:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD + w
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of (lang, text) rows, one per language for about every BLOCK_BYTES of text."""
    ids, langs, size = _Ids(), {}, 0

    def close() -> Iterator[Block]:
        vocabulary = list(ids)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        for lang, parts in langs.items():
            yield Block(lang, parts, vocabulary, hashes)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            found = split_words(text)
            langs.setdefault(lang, []).append(np.fromiter(
                (-1 if w == _BREAK else ids[w] for w in (*found, _BREAK)), np.int32, len(found) + 1))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from close()
                ids, langs, size = _Ids(), {}, 0
    yield from close()


class _Marks:
    """Reader of a bitmap of hashes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes % np.uint64(8 * len(self.bits))
        return (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _local_counts(hashes: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
    values, counts = np.unique(hashes, return_counts=True)
    for lo in range(0, len(values), BATCH_ROWS):
        part = values[lo: lo + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.view(np.int64)), pa.array(np.full(len(part), shard, np.int32)), pa.array(counts[lo: lo + BATCH_ROWS].astype(np.int64))],
            names=["hash", "shard", "c"])


def _promising(texts: DataFrame, count, min_count: int) -> DataFrame:
    """hash of the phrases that are frequent in a shard and can reach ``min_count`` in all."""
    least = -(-min_count // (SHARDS * SLACK))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for block in _blocks(batches):
            for hashes in count(block):
                yield from _local_counts(hashes, shard)

    # rows of a block are distinct already, so nothing is combined before the shuffle, which also serves the last sum
    parts = texts.mapInArrow(mine, "hash bigint, shard int, c bigint").repartition("hash")
    frequent = parts.groupBy("hash", "shard").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    # a shard that does not name a phrase holds it at most least - 1 times
    most = F.sum(F.col("c") - (least - 1)) + SHARDS * (least - 1)
    return stage(frequent.groupBy("hash").agg(most.alias("most")).where(F.col("most") >= min_count).select("hash"))


def mine_shards(texts: DataFrame, min_count: int) -> DataFrame:
    """hash of every phrase (of lang, text rows) that can reach ``min_count``, and of few others."""
    def short(block: Block) -> Iterator[np.ndarray]:
        for n in (1, 2):
            yield block.hashes(n, block.positions(n))

    pairs = _promising(texts, short, min_count)
    sent = texts.sparkSession.sparkContext.broadcast(union_bitmap(pairs))

    def long(block: Block) -> Iterator[np.ndarray]:
        at = block.positions(2)
        good = np.zeros(len(block.row), bool)
        good[at[_Marks(sent.value)(block.hashes(2, at))]] = True
        whole = good
        for n in range(3, LONGEST + 1):
            whole = whole[:-1] & good[n - 2:]
            yield block.hashes(n, np.flatnonzero(whole))

    return pairs.unionByName(_promising(texts, long, min_count))


def union_bitmap(union: DataFrame) -> np.ndarray:
    """Marks the hashes of ``union``: made in blocks by the tasks, at most MOST_BITS reach the driver."""
    wanted = 16 * union.count()
    bits = max(BLOCK_BITS, min(MOST_BITS, 1 << max(0, wanted - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            for block in np.unique(bit // np.uint64(BLOCK_BITS)).tolist():
                here = blocks.setdefault(block, np.zeros(BLOCK_BITS, bool))
                here[bit[bit // np.uint64(BLOCK_BITS) == block] % np.uint64(BLOCK_BITS)] = True
        for block, here in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(here, bitorder="little").tobytes()])],
                                             names=["block", "bits"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts["bits"]])
        return parts.head(1).assign(bits=[whole.tobytes()])

    schema = "block bigint, bits binary"
    blocks = union.select("hash").mapInArrow(mark, schema).groupBy("block").applyInPandas(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block * BLOCK_BITS // 8: (row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def count_union(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """lang, phrase, a: counts by block of the phrases whose hashes are marked; under the empty phrase the number of words."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def rows(lang: str, phrases: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(phrases), BATCH_ROWS):
            part = phrases[lo: lo + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                                              pa.array(counts[lo: lo + BATCH_ROWS].astype(np.int64))], names=["lang", "phrase", "a"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _Marks(sent.value)
        for block in _blocks(batches):
            yield from rows(block.lang, [""], np.array([np.count_nonzero(block.row >= 0)]))
            for n, first, found in block.levels(lambda n, first: marked(block.hashes(n, first))):
                yield from rows(block.lang, block.phrases(n, first), found)

    return texts.mapInArrow(count, "lang string, phrase string, a bigint")


def mine_collocations(docs: DataFrame, min_count: int = 100, covered: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to five words by their weakest cut.

    Words, pieces and counts are those of the module; ``a`` is the phrase's count, at least ``min_count``; l and r are the counts of
    the two sides of its cut with the lowest score, floor(1000 a n / (l r)), ties to the first cut; n counts the words of the
    language. A phrase inside a longer one that has ``covered`` per cent of its count is left out. Null texts count as empty, a
    null language as ``und``; texts and languages without words give nothing. Repeated rows count each; doc_id and
    other columns are not read. Order: score and a descending, phrase by its bytes.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    union = mine_shards(texts, min_count)
    counted = count_union(texts, union_bitmap(union)).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    counted = stage(counted.where((F.col("phrase") == "") | (F.col("a") >= min_count)))
    return rank_collocations(counted, covered, top)


def rank_collocations(counted: DataFrame, covered: int, top: int) -> DataFrame:
    """The ranking of :func:`mine_collocations` from counts by language and phrase, with the words' number under ''."""
    totals = counted.where("phrase = ''").select("lang", F.col("a").alias("n"))
    words = F.split("phrase", " ")
    known = counted.where("phrase <> ''")
    longer = known.withColumn("words", words).where("size(words) >= 2")

    def run(start: str, length: str) -> str:
        return f"array_join(slice(words, {start}, {length}), ' ')"

    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)"))).select(
        "lang", "phrase", "a", "k", F.expr(run("1", "k")).alias("left"), F.expr(run("k + 1", "size(words) - k")).alias("right"))
    sides = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    scored = (cuts.join(sides, ["lang", "left"])
              .join(sides.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
              .join(totals, "lang")
              .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(16,0)))"
                                          " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")))
    weakest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    inside = (longer.where("size(words) >= 3")
              .withColumn("length", F.explode(F.expr("sequence(2, size(words) - 1)")))
              .withColumn("start", F.explode(F.expr("sequence(1, size(words) - length + 1)")))
              .groupBy("lang", F.expr(run("start", "length")).alias("phrase")).agg(F.max("a").alias("held")))
    free = weakest.join(inside, ["lang", "phrase"], "left").where(
        F.col("held").isNull() | (100 * F.col("held") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
