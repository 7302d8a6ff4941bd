"""n-gram Jaccard join with a prefix tree.

Links are found exactly, in these steps:

1. Every text becomes a set of shingle hashes. Texts with equal sets are one from here on.
2. All sets are ordered by one global order: shingles known to be frequent last, the rest by hash.
   Two sets with Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles, so only
   sets that meet under such a shingle can be linked. Which shingles count as frequent is found
   on the first few of each set, and at most MOST_FREQUENT do; the choice moves work but not results. The list is
   known to the tasks that make the prefixes, so no set is moved to be ordered. The first shingle two similar
   sets share lies even earlier in the smaller one, n - ceil(2 t n / (1 + t)) + 1: what meets later in it
   is not compared.
3. Under each shingle every set is compared with the smallest one there, as far as lengths and a
   parity bitmap (a lower bound on the number of shingles not shared) allow a link. Sets that
   share a partner go into one prefix tree of ordered sets; a probe goes down the tree, partial
   overlaps are shared by all sets below, and a branch is left when overlap so far plus the shorter
   rest cannot reach the threshold.
4. Links so far give classes. Groups of more than LARGE sets are cut at random into blocks of bounded size, and in every
   block the likeliest links between classes, a forest of them, are tried. So the sets of a large class
   come together by at most PROBES pairs a set, however many links the class has.
5. Of what then meets under a shingle, only sets that have a partner of another
   class there, by size and place, are compared pairwise by bitmap, and what passes goes through a
   prefix tree of its own. Large groups are cut by bands of size, since similar sets lie in one band or in
   neighbouring ones, and then into pairs of blocks of bounded size. The largest class of a group is not paired with
   itself: its blocks meet only those of the other classes. So no link between classes is missed, and copies never become all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches
from tickloom.llm.components import components
from tickloom.llm.shingles import shingle_set
from tickloom.plans.staging import stage

#: Similarity in percent, words per shingle.
PERCENT, WORDS = 80, 5
#: First shingles of a set that are counted to find frequent ones, and how many sets make one frequent.
SKETCH, FREQUENT = 16, 64
#: Frequent shingles the tasks are told, the commonest.
MOST_FREQUENT = 1 << 16
LEAST_BITS = 1024
#: Ratio of the sizes in one band; a little more than similar sets can have.
BAND = 1.26
#: Words of the broadcast sieve.
SIEVE_WORDS = 1 << 16
#: Sets per block of a large group; rows one Python call gets.
BLOCK, CALL_ROWS = 256, 512
#: Sets of a group whose classes are brought together before all pairs of classes are compared; random blocks a set goes to.
LARGE, PROBES = 1024, 8


def needed_overlap(a, b, percent: int = PERCENT):
    """Least intersection of sets of sizes a and b that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Trie:
    """Compressed prefix tree of sorted arrays, with bounds on the sets below every node."""

    __slots__ = ("edge", "children", "ends", "rest", "least")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends = edge, {}, []
        self.rest, self.least = 0, np.iinfo(np.int64).max  # longest rest below the edge; smallest set below

    def insert(self, number: int, items: np.ndarray) -> None:
        node, at, size = self, 0, len(items)
        while True:
            node.rest, node.least = max(node.rest, size - at), min(node.least, size)
            if at == size:
                node.ends.append(number)
                return
            child = node.children.get(int(items[at]))
            if child is None:
                child = Trie(items[at:])
                child.ends.append(number)
                child.least = size
                node.children[int(items[at])] = child
                return
            same = min(len(child.edge), size - at)
            differ = np.flatnonzero(child.edge[:same] != items[at: at + same])
            shared = int(differ[0]) if len(differ) else same
            if shared < len(child.edge):
                upper = Trie(child.edge[:shared])
                upper.rest, upper.least = child.rest + len(child.edge) - shared, child.least
                child.edge = child.edge[shared:]
                upper.children[int(child.edge[0])] = child
                node.children[int(items[at])] = upper
                child = upper
            node, at = child, at + shared

    def search(self, probe: np.ndarray, sizes: list[int], skip, percent: int = PERCENT):
        """Yield numbers of stored sets similar to ``probe``; sets with skip(number) are not asked for."""
        n = len(probe)
        todo = [(self, 0, 0)]
        while todo:
            node, at, overlap = todo.pop()
            if len(node.ends) == 1 and not node.children and skip(node.ends[0]):
                continue
            if len(node.edge):
                rest = probe[at:]
                place = np.searchsorted(rest, node.edge)
                inside = place < len(rest)
                overlap += int((rest[place[inside]] == node.edge[inside]).sum())
                at += int(np.searchsorted(rest, node.edge[-1], side="right"))
            if overlap + min(n - at, node.rest) < needed_overlap(n, node.least, percent):
                continue
            for number in node.ends:
                if not skip(number) and 100 * overlap >= percent * (n + sizes[number] - overlap):
                    yield number
            todo.extend((child, at, overlap) for child in node.children.values())


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect every class of similar sets (a spanning forest), as pairs of positions."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    root, sizes, out = Trie(np.zeros(0, dtype=np.uint64)), [len(s) for s in sets], []
    for i, items in enumerate(sets):
        for j in root.search(items, sizes, lambda x, i=i: find(x) == find(i), percent):
            if find(i) != find(j):
                parent[find(i)] = find(j)
                out.append((j, i))
        root.insert(i, items)
    return out


NAME = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
BEGIN = T.StructType([T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bitmap", T.ArrayType(T.LongType()))])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def parity_bitmap(items: np.ndarray) -> np.ndarray:
    """Parity of the hashes in each of at least n places, a power of two; half the places fold into the other half."""
    width = max(LEAST_BITS, 1 << max(len(items) - 1, 0).bit_length())
    bits = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2:]
    return words


def _named(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit sums that stand for a whole set."""
    spin = [int(np.bitwise_xor.reduce(s * np.uint64(0xFF51AFD7ED558CCD))) if len(s) else 0 for s in sets]
    total = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    return [pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (total, spin))]


@F.arrow_udf(T.StructType([*NAME.fields, T.StructField("sketch", T.ArrayType(T.LongType()))]))
def _name(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t, WORDS) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [*_named(sets), _lists([s[: min(SKETCH, prefix_length(len(s)))] for s in sets])], [*NAME.names, "sketch"])


def ordered_prefix(items: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order; both arrays are sorted."""
    size = prefix_length(len(items))
    if not len(frequent):
        return items[:size]
    last = frequent[np.minimum(np.searchsorted(frequent, items), len(frequent) - 1)] == items
    return np.concatenate([items[~last], items[last]])[:size]


def _begin(spark: SparkSession, frequent: np.ndarray):
    """A function of texts: name, prefix in the global order, bitmap."""
    told = spark.sparkContext.broadcast(frequent)

    @F.arrow_udf(T.StructType([*NAME.fields, *BEGIN.fields]))
    def begin(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t, WORDS) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [*_named(sets), _lists([ordered_prefix(s, told.value) for s in sets]), _lists([parity_bitmap(s) for s in sets])],
            [*NAME.names, *BEGIN.names])

    return begin


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose id may be among the wanted ``rep``: all that are, and few others.

    A table of at most SIEVE_WORDS words of 64 bits, whatever the input, is broadcast; so most texts stay
    out of the joins that follow without being moved. It drops nothing that is wanted.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * SIEVE_WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {64 * SIEVE_WORDS}) % 64 as int))")
    sieve = wanted.select(F.floor(place("rep") / 64).alias("__word"), bit("rep").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    tagged = texts.withColumn("__word", F.floor(place("doc_id") / 64))
    return (tagged.join(F.broadcast(sieve), "__word").where(F.col("__bits").bitwiseAND(bit("doc_id")) != 0)
            .select(F.col("doc_id").alias("rep"), "text"))


def _joined(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of a prefix tree per group. ``groups``: g, rep; groups have bounded size."""
    calls = max(1, -(-groups.count() // CALL_ROWS))
    rows = (groups.join(_among(texts, groups.select("rep").distinct()), "rep")
            .withColumn("call", F.pmod(F.xxhash64("g"), F.lit(calls))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("g", sort=False):
            part = part.sort_values("rep", kind="stable")
            reps = part["rep"].to_numpy()
            for i, j in links([shingle_set(t, WORDS) for t in part["text"]]):
                a.append(int(reps[i]))
                b.append(int(reps[j]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("call").applyInPandas(run, "a bigint, b bigint")


#: A pair of entries (2 n + 1 within the early places of its set, else 2 n) under its first common shingle: the smaller
#: set, both of equal ones, must have it early, and sizes must be close enough.
MAY_BE_FIRST = (f"(least({{a}}, {{b}}) & 1L) = 1 and 100 * shiftright(least({{a}}, {{b}}), 1) >= {PERCENT} * shiftright(greatest({{a}}, {{b}}), 1)")


def _entries(sets: DataFrame, items: Column) -> DataFrame:
    """(token, rep, entry) for the shingles in ``items``, the first ones of sets of n in the global order."""
    early = F.expr(f"n - ceil(2 * {PERCENT} * n / {100.0 + PERCENT}D) + 1")
    return (sets.select("rep", "n", F.posexplode(items).alias("place", "token"))
            .select("token", "rep", (2 * F.col("n").cast("bigint") + (F.col("place") < early).cast("bigint")).alias("entry")))


def _banded(met: DataFrame) -> DataFrame:
    """Groups of more than BLOCK entries cut by bands of size, every two neighbouring bands together.

    ``main`` tells the entries of a band's largest class, ``mains`` and ``others`` how many are and are not.
    """
    band = F.floor(F.log(F.shiftright("entry", 1).cast("double")) / float(np.log(BAND)))
    small = met.where(F.col("c") <= BLOCK).select("token", "rep", "entry", "class", F.lit(-1).cast("bigint").alias("band"),
                                                  F.lit(False).alias("main"), F.lit(0).cast("bigint").alias("mains"), F.col("c").alias("others"))
    large = met.where(F.col("c") > BLOCK).drop("c").withColumn("band", F.explode(F.array(band, band - 1)))
    sizes = (large.groupBy("token", "band", "class").agg(F.count("*").alias("c"))
             .groupBy("token", "band").agg(F.sum("c").alias("c"), F.max(F.struct("c", "class")).alias("m"))
             .where("c > m.c").select("token", "band", F.col("m.class").alias("largest"), F.col("m.c").alias("mains"), (F.col("c") - F.col("m.c")).alias("others")))
    return small.unionByName(large.join(sizes, ["token", "band"]).withColumn("main", F.expr("class = largest")).drop("largest"))


def _blocked(groups: DataFrame) -> DataFrame:
    """Cut groups into blocks of about BLOCK entries, those of the largest class (numbered below 0) apart, and put
    together every pair of blocks that may hold different classes: (token, band, lo, hi)."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("bigint")
    rest = F.sequence(F.lit(0).cast("bigint"), blocks("others") - 1)
    main = F.when(F.col("mains") > 0, F.sequence(-blocks("mains"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    own = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("rep"), blocks("mains"))).otherwise(F.pmod(F.xxhash64("rep"), blocks("others")))
    cut = groups.withColumn("__own", own).withColumn("__other", F.explode(F.when(F.col("main"), rest).otherwise(F.concat(main, rest))))
    return (cut.withColumn("lo", F.least("__own", "__other")).withColumn("hi", F.greatest("__own", "__other"))
            .drop("main", "mains", "others", "__own", "__other"))


def _to_compare(named: DataFrame) -> DataFrame:
    """Staged (g, rep): groups of sets of which each has one of another class to be compared with. ``named``: token, rep,
    entry, class, c."""
    pair = MAY_BE_FIRST.format(a="x.entry", b="y.entry")
    groups = (_blocked(_banded(named)).groupBy("token", "band", "lo", "hi")
              .agg(F.collect_set(F.struct("rep", "entry", "class")).alias("all"), F.min("class").alias("c0"), F.max("class").alias("c1"))
              .where("c0 <> c1")
              .select(F.expr(f"filter(all, x -> exists(all, y -> x.class <> y.class and {pair}))").alias("kept"))
              .where("size(kept) > 1").select(F.expr("array_sort(array_distinct(transform(kept, x -> x.rep)))").alias("reps"))
              .select(F.xxhash64("reps").alias("g"), "reps").distinct())
    return stage(groups.select("g", F.explode("reps").alias("rep")).distinct())


def _frequent(sketches: DataFrame) -> np.ndarray:
    """The commonest shingles in ``sketch`` of more than FREQUENT sets, at most about MOST_FREQUENT, sorted.

    They are cut by their counts in narrow classes, inside the last class by hash; only the list comes to the driver.
    """
    counted = stage(sketches.select(F.explode("sketch").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
                    .where(F.col("c") > FREQUENT).select("token", F.floor(F.log2("c") * 16).alias("level")))
    room, share = MOST_FREQUENT, {}
    for row in counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        share[row.level] = 65536 * min(room, row.n) // row.n
        room -= min(room, row.n)
    among = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in share.items()], F.lit(0))
    found = counted.where(F.col("token").bitwiseAND(F.lit(65535)) < among).select("token").collect()
    return np.unique(np.array([r.token for r in found], dtype=np.int64).view(np.uint64))


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at least PERCENT percent similarity,
    the own id included. A text shorter than WORDS words is one shingle; empty and null texts have none and
    are linked with nothing. A row without id has no component and links nothing. Repeated rows are
    rows of the same class; different texts under one id are in one class too. Whole texts are read.
    Other columns are ignored; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    begun = stage(texts.select("doc_id", _name("text").alias("s")).select("doc_id", "s.*"))
    some = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    named, rest = begun.where(some), begun.where(~some)
    same = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = stage(named.select("doc_id", "n", "s1", "s2").join(same, ["n", "s1", "s2"]).select("doc_id", "n", "rep")
                    .unionByName(rest.select("doc_id", "n", F.lit(None).cast("bigint").alias("rep"))))
    # copies count once
    frequent = _frequent(named.groupBy("n", "s1", "s2", "sketch").agg(F.count("*")))
    # the beginning of one set of each name; copies are combined before the shuffle
    # (a condition on the name would be pushed down and run the function twice)
    begin = texts.where("doc_id is not null").select("doc_id", _begin(docs.sparkSession, frequent)("text").alias("s")).select("doc_id", "s.*")
    reps = stage(begin.select("n", "s1", "s2", F.struct("doc_id", "prefix", "bitmap").alias("b"))
                 .groupBy("n", "s1", "s2").agg(F.min("b").alias("b")).where(F.size("b.prefix") > 0)
                 .select(F.col("b.doc_id").alias("rep"), "n", "b.prefix", "b.bitmap"))
    facts = reps.select("rep", "n", "bitmap")

    by_token = _entries(reps, F.col("prefix")).repartition("token")
    met = (by_token.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("rep", "entry")).alias("pivot"),
                                         F.max(F.col("entry") % 2).alias("early")).where("c > 1 and early = 1").drop("early"))
    met = stage(by_token.join(met, "token").select("token", "rep", "entry", F.col("pivot.rep").alias("pivot"),
                                                   F.col("pivot.entry").alias("first"), "c"))

    stars = met.where("rep <> pivot and " + MAY_BE_FIRST.format(a="entry", b="first")).select("pivot", "rep").distinct()
    left = facts.select(F.col("rep").alias("pivot"), F.col("n").alias("pn"), F.col("bitmap").alias("pb"))
    possible = f"100 * least(n, pn) >= {PERCENT} * greatest(n, pn)"
    half = lambda c, d: (f"case when size({c}) > size({d}) then zip_with(slice({c}, 1, size({d})), slice({c}, size({d}) + 1, size({d})),"  # noqa: E731
                         f" (x, y) -> x ^ y) else {c} end")
    apart = f"aggregate(zip_with({half('bitmap', 'pb')}, {half('pb', 'bitmap')}, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"
    most_apart = f"n + pn - 2 * cast(ceil({PERCENT} * (n + pn) / {100.0 + PERCENT}D) as int)"
    stars = stage(stars.join(facts, "rep").join(left, "pivot").where(possible).where(f"{apart} <= {most_apart}").select("pivot", "rep"))
    first = _linked_stars(texts, stars)
    classes = stage(components(first))

    likely = _blocks_of_large(_classed(met, classes))
    if not likely.isEmpty():
        more = _linked_stars(texts, _close_pairs(likely, facts, classes, likely_tree))
        classes = stage(components(_edges(classes).unionByName(more)))

    rest = _to_compare(_classed(met, classes))
    second = _linked_stars(texts, _close_pairs(rest, facts, classes, close_in_group))
    label = components(_edges(classes).unionByName(second)).select(F.col("node").alias("rep"), "component")
    return (members.join(label, "rep", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                    F.coalesce("component", "rep", "doc_id").alias("component_id")))


def _edges(classes: DataFrame) -> DataFrame:
    """(a, b) from every node to the smallest of its class."""
    return classes.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _classed(met: DataFrame, classes: DataFrame) -> DataFrame:
    """token, rep, entry, class, c: what meets, with the classes found so far; a set without links is its own."""
    return met.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "token", "rep", "entry", F.coalesce("component", "rep").alias("class"), "c")


def _blocks_of_large(named: DataFrame) -> DataFrame:
    """Staged (g, rep): random blocks of about BLOCK sets of the groups of more than LARGE that hold several classes.

    Every group is cut twice, and a set goes to at most PROBES blocks; which ones is decided by a hash, so sets
    that share many large groups choose the same. ``named``: token, rep, class, c.
    """
    several = (named.where(F.col("c") > LARGE).groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1"))
               .where("c0 <> c1").select("token"))
    cut = named.where(F.col("c") > LARGE).join(several, "token").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    first = Window.partitionBy("rep").orderBy(F.xxhash64("token", "turn"), "token", "turn")
    block = F.pmod(F.xxhash64("rep", "token", "turn"), F.ceil(F.col("c") / BLOCK).cast("bigint"))
    return stage(cut.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PROBES)
                 .select(F.xxhash64("token", "turn", block).alias("g"), "rep"))


def _linked_stars(texts: DataFrame, stars: DataFrame) -> DataFrame:
    """Staged links among candidates: every pivot with its partners in one prefix tree, in blocks."""
    load = stars.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = stars.join(load, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep")
    whole = stage(cut.unionByName(cut.select("pivot", "block", F.col("pivot").alias("rep")).distinct())
                  .select(F.xxhash64("pivot", "block").alias("g"), "rep"))
    return stage(_joined(whole, texts))


def _in_reach(n: np.ndarray, named: np.ndarray, maps: list[np.ndarray]):
    """For every i the later j of different classes that lengths and bitmaps let be similar, and how many shingles
    at least only one of both has; bitmaps meet at the smaller width."""
    widths = np.array([len(m) for m in maps])
    folded, place = {}, {}
    for w in np.unique(widths):
        among = np.flatnonzero(widths >= w)
        folded[w] = np.stack([_folded(maps[k], w) for k in among])
        place[w] = np.full(len(maps), -1)
        place[w][among] = np.arange(len(among))
    for i in range(len(maps) - 1):
        later = np.flatnonzero((named[i + 1:] != named[i]) & (100 * np.minimum(n[i], n[i + 1:]) >= PERCENT * np.maximum(n[i], n[i + 1:]))) + i + 1
        for w in folded:
            if w > widths[i]:
                continue
            js = later[widths[later] >= w] if w == widths[i] else later[widths[later] == w]
            if len(js):
                apart = np.bitwise_count(folded[w][place[w][js]] ^ folded[w][place[w][i]]).sum(axis=1).astype(np.int64)
                close = apart <= n[i] + n[js] - 2 * needed_overlap(n[i], n[js])
                yield i, js[close], apart[close]


def close_in_group(n: np.ndarray, named: np.ndarray, maps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs i < j of different classes that lengths and bitmaps let be similar."""
    return [(i, int(j)) for i, js, _ in _in_reach(n, named, maps) for j in js]


def likely_tree(n: np.ndarray, named: np.ndarray, maps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of the pairs of ``close_in_group`` a forest that joins the classes, of the greatest similarity bitmaps allow."""
    near = np.zeros((len(maps), len(maps)))
    for i, js, apart in _in_reach(n, named, maps):
        near[i, js] = near[js, i] = (n[i] + n[js] - apart) / (n[i] + n[js] + apart)
    near[named[:, None] == named[None, :]] = 2  # joined already
    best, via, outside, out = np.zeros(len(maps)), np.zeros(len(maps), dtype=np.int64), np.ones(len(maps), dtype=bool), []
    for _ in maps:
        i = int(np.argmax(np.where(outside, best, -1)))
        if 0 < best[i] < 2:
            out.append((int(min(i, via[i])), int(max(i, via[i]))))
        outside[i] = False
        better = near[i] > best
        best[better], via[better] = near[i][better], i
    return out


def _close_pairs(groups: DataFrame, facts: DataFrame, classes: DataFrame, choose) -> DataFrame:
    """Staged (pivot, rep): what ``choose`` takes of the pairs of different classes in a group; ``groups``: g, rep."""
    calls = max(1, -(-groups.count() // (4 * CALL_ROWS)))
    rows = (groups.join(facts, "rep").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .withColumn("class", F.coalesce("component", "rep")).drop("component")
            .withColumn("call", F.pmod(F.xxhash64("g"), F.lit(calls))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("g", sort=False):
            reps = part["rep"].to_numpy()
            maps = [np.asarray(w).view(np.uint64) for w in part["bitmap"]]
            for i, j in choose(part["n"].to_numpy().astype(np.int64), part["class"].to_numpy(), maps):
                a.append(int(min(reps[i], reps[j])))
                b.append(int(max(reps[i], reps[j])))
        return pd.DataFrame({"pivot": np.array(a, np.int64), "rep": np.array(b, np.int64)}).drop_duplicates()

    return stage(rows.groupBy("call").applyInPandas(run, "pivot bigint, rep bigint").distinct())
