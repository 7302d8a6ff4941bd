"""Spelling variants: words one edit apart, found with FM-indexes over the vocabulary.

One inserted, deleted or replaced code point lies in one half of a word, so the other half stands unchanged at its end of the
near word. Two searches cover both cases: one matches the second half exactly and extends leftwards over the first, allowing
one error; the other matches the first half and extends rightwards. The second is the first on reversed words, so the index is
held in both directions. An interval of suffix ranks of the delimited words stands for all places where what has been read so far
occurs; the delimiter before a word turns an interval into words.

A near word shares at least its first three (or last three) code points with the word, so the vocabulary is dealt by them and a
word is only looked up where they are equal. Keys with very many words are cut into blocks, each an index of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

#: Words are at least this long, so that a half has KEY code points.
SHORTEST = 7
KEY = 3
#: Words of an index when keys are put together, and of a block of one key.
TOGETHER = 8_000
BLOCK = 30_000
#: Words searched at a time.
AT_ONCE = 2_000

#: Distinct words a task sums before it hands them on.
REMEMBERED = 200_000
#: Maximal runs of letters; only those of SHORTEST code points can become words.
RUN = re.compile(rf"[A-Za-z\u00C0-\u00FF]{{{SHORTEST},}}")


class SuffixRanks:
    """FM-index of distinct words, each closed by a delimiter of its own; delimiters come first in word order."""

    def __init__(self, words: list[str]) -> None:
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        total, count = len(points) + len(words), len(words)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(total, np.int64)
        letters = np.ones(total, bool)
        letters[ends] = False
        text[letters] = codes + 1
        owner = np.repeat(np.arange(count), sizes + 1)
        # rank of every suffix by doubling; delimiters differ, so no comparison goes past one
        rank = text + count
        rank[ends] = np.arange(count)
        step = 1
        while True:
            following = np.append(rank[step:], np.zeros(min(step, total), np.int64))
            values, rank = np.unique(rank * (total + count + len(self.alphabet) + 2) + following, return_inverse=True)
            if len(values) == total:
                break
            step *= 2
        suffixes = np.empty(total, np.int64)
        suffixes[rank] = np.arange(total)
        begins = ends - sizes
        before = np.append(0, text)[suffixes]
        starts = np.zeros(total, bool)
        starts[begins] = True
        before[starts[suffixes]] = 0
        self.total, self.count = total, count
        # sorted (symbol before a suffix, its rank): the place of (c, i) is the rank where interval border i goes by c
        self.steps = np.sort(before * total + np.arange(total))
        self.words_by_rank = owner[suffixes[starts[suffixes]]]

    def code(self, points: np.ndarray) -> np.ndarray:
        """Symbol of each code point, -1 if the words have none such."""
        at = np.searchsorted(self.alphabet, points)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == points[known]
        return np.where(known, at + 1, -1)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that have ``symbol`` before those of [lo, hi); empty for unknown symbols."""
        base = np.maximum(symbol, 0) * self.total
        low, high = np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)
        return low, np.where(symbol < 0, low, high)


def one_edit(index: SuffixRanks, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of all words one edit from a query whose last ``exact`` code points they keep in place."""
    sizes = np.array([len(w) for w in queries], np.int64)
    width = int(sizes.max(initial=0))
    codes = np.full((len(queries), width), -1, np.int64)  # from the end backwards
    flat = index.code(np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32))
    row = np.repeat(np.arange(len(queries)), sizes)
    codes[row, np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(flat))] = flat
    symbols = np.arange(1, len(index.alphabet) + 1)
    nothing = np.zeros(0, np.int64)
    # clean: read without error so far; spent: the error is made. Columns: query, interval
    clean = (np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), index.count))
    spent, found = (nothing, nothing, nothing), []

    def some(part: tuple, mask: np.ndarray) -> tuple:
        return tuple(x[mask] for x in part)

    def joined(parts: list[tuple]) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*parts))

    def read(part: tuple, symbol: np.ndarray) -> tuple:
        lo, hi = index.extend(part[1], part[2], symbol)
        return some((part[0], lo, hi), hi > lo)

    for t in range(width + 1):
        branch = some(clean, exact[clean[0]] <= t)
        every = tuple(np.repeat(x, len(symbols)) for x in branch)
        lo, hi = index.extend(every[1], every[2], np.tile(symbols, len(branch[0])))
        grown, symbol = (every[0], lo, hi), np.tile(symbols, len(branch[0]))
        symbol, grown = symbol[hi > lo], some(grown, hi > lo)
        spent = joined([spent, grown])  # one more code point in the word
        done = sizes[spent[0]] == t
        found.append(some(spent, done))
        spent = some(spent, ~done)
        clean = some(clean, sizes[clean[0]] > t)
        if t == width:
            break
        here = codes[:, t]
        open_branch = some(branch, sizes[branch[0]] > t)
        replaced = (sizes[grown[0]] > t) & (symbol != here[grown[0]])
        spent = joined([read(spent, here[spent[0]]), some(grown, replaced), open_branch])  # the last: one code point less
        clean = read(clean, here[clean[0]])
    query, lo, hi = joined(found)
    lo, hi = index.extend(lo, hi, np.zeros(len(lo), np.int64))
    width_of = hi - lo
    query = np.repeat(query, width_of)
    place = np.repeat(lo, width_of) + np.arange(len(query)) - np.repeat(np.cumsum(width_of) - width_of, width_of)
    return query, index.words_by_rank[place]


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Near pairs inside one group of rows (side, role, word, n)."""
    targets = group[group["role"] == "target"].sort_values("word")
    queries = group.loc[group["role"] == "query", "word"].tolist()
    mirrored = group["side"].iloc[0] == "first"
    turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
    words, counts = targets["word"].tolist(), targets["n"].to_numpy()
    out = []
    if words:
        index = SuffixRanks([turn(w) for w in words])
        names = np.array(words, object)
        for lo in range(0, len(queries), AT_ONCE):
            some = queries[lo: lo + AT_ONCE]
            sizes = np.array([len(w) for w in some], np.int64)
            which, hit = one_edit(index, [turn(w) for w in some], sizes // 2 if mirrored else sizes - sizes // 2)
            pairs = np.unique(which * len(words) + hit)
            which, hit = pairs // len(words), pairs % len(words)
            out.append(pd.DataFrame({"word": np.array(some, object)[which], "near": names[hit], "near_n": counts[hit]}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "near": [], "near_n": []})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words (both ways) of ``vocabulary`` (word, n; distinct) that differ by one edit.

    Words shorter than SHORTEST code points are not compared.
    """
    words = vocabulary.where(F.char_length("word") >= SHORTEST).select(
        "word", "n", F.inline(F.array(
            F.struct(F.lit("first").alias("side"), F.left("word", F.lit(KEY)).alias("key")),
            F.struct(F.lit("last").alias("side"), F.right("word", F.lit(KEY)).alias("key")))))
    bins = max(1, -(-vocabulary.count() // TOGETHER))
    keys = words.groupBy("side", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    words = words.join(keys, ["side", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    # keys with few words share an index; a full key has blocks x blocks groups, each word in one row and one column of them
    place = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins)).cast("string"))
    others = words.withColumn("bin", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = others.select("side", "word", "n", "bin", F.inline(F.array(
        F.struct(F.lit("target").alias("role"), F.col("block").alias("x"), F.col("other").alias("y")),
        F.struct(F.lit("query").alias("role"), F.col("other").alias("x"), F.col("block").alias("y")))))
    # keys are letters and bins are numbers, so names do not meet
    found = rows.groupBy("side", "bin", "x", "y").applyInPandas(_search, "word string, near string, near_n bigint")
    return found.distinct()


def count_words(docs: DataFrame, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: letter runs of all texts, lower-cased (A-Z), of at least SHORTEST code points and ``least`` occurrences.

    Where ``every`` divides crc32 of ``doc_id:run``, one code point of the run is left out. A null doc_id counts as an empty
    one, null texts have no words. Tasks hand on sums, at least once for REMEMBERED words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower() changes A-Z only
                found = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))
                start = zlib.crc32(f"{key or ''}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < SHORTEST:
                            continue
                    sums[word] += n
                if len(sums) > REMEMBERED:
                    yield rows()
                    sums.clear()
        yield rows()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def follow_forms(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): chains of forms followed to their last word by doubling."""
    links = stage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stage(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        links = longer.select("word", "root")
        if longer.where("further is not null").isEmpty():
            return links


def group_variants(docs: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of :func:`count_words`.

    ``form`` is the near word with most occurrences (ties: the smallest by code points) if it has ``factor`` times those of the word,
    else null, as is form_n; ``root`` is the end of the chain of forms, the word itself without form. Occurrences grow along
    a chain, so it ends. Repeated rows count each; empty tables give no rows; columns other than doc_id and text are not read.
    """
    vocabulary = stage(count_words(docs))
    best = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    told = F.coalesce(-F.col("best.minus") >= factor * F.col("n"), F.lit(False))
    forms = stage(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(told, F.col("best.near")).alias("form"), F.when(told, -F.col("best.minus")).alias("form_n")))
    return forms.join(follow_forms(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
