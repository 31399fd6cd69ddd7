"""N-gram Jaccard join by vertical partitioning.

Word shingles are put in one global order (that of their hashes), and the order is cut into
fragments. Two sets that link differ in few shingles, so with more fragments than that, one at
least holds the same shingles in both: equal fragments name the candidates. The overlap of a
candidate pair is counted fragment by fragment and summed per pair.

There are more fragments than linked sets can differ in, so a set leaves out its most frequent
ones: linked sets still meet in the rarest that they share. Fragments that no two sets share, and
those of passages that many documents hold, thus make no lists.

Only components are asked for, so a group of n near copies never becomes n * n pairs: each list
of documents with an equal fragment first tries all of them against the one that is in most lists
(star); pairs are then tried only where a list still holds several components, behind an exact
bound on the overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import WORD, cut, in_chunks, passing, small_batches
from palimpsest.llm.components import components
from palimpsest.llm.words import Words

#: Sizes that differ by this factor stand in the next class; a class has one cut of the order.
CLASS_RATIO = 1.5
#: Fragments beyond the number that can differ: so many, and one for every SPARE_OF of that number.
SPARE, SPARE_OF = 3, 4
#: Fragments of the order in which overlaps are counted.
PARTS = 16
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    x = (x ^ (x >> np.uint64(29))) * _MIX3
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer words: one of all of them; none: empty."""
    w = Words(texts, plain=True)
    words = w.hashes(w.starts, w.ends)
    total = np.zeros(len(words), dtype=np.uint64)
    for j in range(width):
        total[: len(words) - j] += np.roll(words, -j)[: len(words) - j] * np.uint64(pow(int(_MIX1), j + 1, 1 << 64))
    total = _stir(total)
    out = []
    for i in range(len(texts)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            weights = np.array([pow(int(_MIX1), j + 1, 1 << 64) for j in range(b - a)], dtype=np.uint64)
            out.append(_stir((words[a:b] * weights).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Threshold:
    """Linked: den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def apart(self, total: int) -> int:
        """Shingles that two linked sets of so many in all can differ in."""
        return total * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=None)
def first_size(c: int) -> int:
    """Least size of class c."""
    return max(c + 1, int(np.ceil(CLASS_RATIO**c)))


def classes_of(n: int, t: Threshold) -> list[int]:
    """The class of size n, and the one below if a set there can link."""
    c = max(0, int(np.log(n) / np.log(CLASS_RATIO)) - 1)
    while first_size(c + 1) <= n:
        c += 1
    return [c, c - 1] if c and t.den * (first_size(c) - 1) >= t.num * n else [c]


def most_apart(n: int, t: Threshold) -> int:
    """Shingles that a set of size n and any that links with it can differ in."""
    return t.apart(n + n * t.den // t.num)


def fragments_of(c: int, t: Threshold) -> int:
    d = most_apart(first_size(c + 1) - 1, t)
    return d + 1 + SPARE + d // SPARE_OF


def cut_order(s: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted hashes fall into each of `parts` ranges, and their sums."""
    bounds = (np.arange(1, parts + 1, dtype=np.float64) * (2.0**64 / parts)).clip(max=2.0**64 - 2048).astype(np.uint64)
    ends = np.searchsorted(s, bounds)
    ends[-1] = len(s)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)))[ends]
    return np.diff(ends, prepend=0), np.diff(sums, prepend=np.uint64(0))


def keys_of(s: np.ndarray, c: int, t: Threshold) -> tuple[np.ndarray, int]:
    """Names of the fragments of a set in class c that hold anything, and how many of them it may leave out.

    A set that links differs in most_apart() fragments at most, so the rarest that both hold, in any
    one order, is among the rarest most_apart() + 1 of each. If neither of two linked sets holds so
    many, they meet by a shingle of their prefixes (prefix filter on the same order).
    """
    count, sums = cut_order(s, fragments_of(c, t))
    held = np.flatnonzero(count)
    names = _stir(sums[held] * _MIX1 + np.uint64(c * int(_MIX2) % 2**64) + held.astype(np.uint64) * _MIX3)
    spare = len(held) - most_apart(len(s), t) - 1
    if spare < 0:
        prefix = s[: len(s) - -(-t.num * len(s) // t.den) + 1]
        names = np.concatenate((names, _stir(prefix * _MIX3 + np.uint64((c * int(_MIX1) + 1) % 2**64))))
    return names.view(np.int64), max(0, spare)


def marks_of(s: np.ndarray, c: int, t: Threshold) -> np.ndarray:
    """A byte for each of four times as many fragments, eight in a long: bytes that differ tell of shingles that do."""
    n = -(-4 * fragments_of(c, t) // 8) * 8
    count, sums = cut_order(s, n)
    return np.where(count > 0, (_stir(sums) >> np.uint64(56)) | np.uint64(1), np.uint64(0)).astype(np.uint8).view(np.int64)


def differing(a: str, b: str):
    """Number of bytes that differ in two arrays of longs."""

    def bytes_set(x, y):
        z = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # the lowest bit of each byte comes to tell whether any of its bits is set
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, bytes_set), F.lit(0), lambda x, y: x + y)


def has_words(text_col: str):
    return F.coalesce(F.regexp_like(F.col(text_col), F.lit(WORD)), F.lit(False))


def jaccard_components(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, one row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased. Null and empty texts
    have no shingle and are linked with nothing. Equal sets are one node. Rows that share an id
    are one document: links of any of them count. A null id is never a component's name unless no
    other is in it. Only the two named columns are read.
    """
    with passing(docs.sparkSession):
        return cut(_components_of(small_batches(docs), Threshold(num, den), width, id_col, text_col), lasting=True)


def _components_of(docs: DataFrame, t: Threshold, width: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit("")).alias("text")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text)
    # A null in a batch would make its ids floating-point.
    all_ = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNotNull().alias("named"), text)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in in_chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].to_numpy(),
                    "named": batch["named"].iloc[a:b].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "x": np.array([s.sum(dtype=np.uint64) for s in sets]).view(np.int64),
                    "y": np.array([_stir(s * _MIX1).sum(dtype=np.uint64) for s in sets]).view(np.int64),
                })

    signed = all_.mapInPandas(sized, "doc_id long, named boolean, n_shingles long, x long, y long")
    signed = cut(signed.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named"))
    same = signed.where("n_shingles > 0").groupBy("n_shingles", "x", "y").agg(F.min("doc_id").alias("node"))
    held = cut(signed.join(same, ["n_shingles", "x", "y"], "left").select("doc_id", "n_shingles", "node"))
    # Rows of one document with different sets are linked.
    several = held.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    own = cut(held.join(several.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    found = _linked(rows, cut(held.where("doc_id = node").select("node").distinct()), own, t, width)
    out = held.join(found, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "node", "doc_id").alias("component_id"))


def _linked(rows: DataFrame, nodes: DataFrame, own: DataFrame, t: Threshold, width: int) -> DataFrame:
    """Components (node, component_id) of the nodes by their links and by own (a, b); nodes without a link are left out."""
    lists = _lists(rows, nodes, t, width)
    sets = cut(_sets(rows, lists.select("node").distinct(), t, width))
    marks = sets.select("node", "n", F.explode("marks").alias("m")).select("node", "n", "m.c", "m.marks")

    # Each document against one hub first, then against the hubs that are not yet with it.
    star = lists.where("node <> hub").select("c", F.col("hub").alias("a"), "degree", F.col("node").alias("b"))
    one = star.groupBy("b").agg(F.max_by(F.struct("c", "a"), F.struct("degree", "a")).alias("s")).select("s.c", "s.a", "b")
    links = _verified(_bounded(one, marks, t), sets, t).union(own)
    comp = components(links)
    more = _verified(_bounded(_apart_still(star, comp).where("comp_a <> comp_b").select("c", "a", "b"), marks, t), sets, t)
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links)

    member = lists.join(comp.withColumnRenamed("component_id", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = member.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("list")
    open_ = cut(member.join(mixed, "list", "left_semi").where("node <> hub").join(marks, ["node", "c"]))
    x, y = open_.alias("x"), open_.alias("y")
    near = (F.col("x.list") == F.col("y.list")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    near &= (t.den * F.least("x.n", "y.n") >= t.num * F.greatest("x.n", "y.n")) & (differing("x.marks", "y.marks") <= _apart(F.col("x.n") + F.col("y.n"), t))
    rest = _verified(x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), sets, t)
    return comp if rest.isEmpty() else components(links.union(rest))


def _lists(rows: DataFrame, nodes: DataFrame, t: Threshold, width: int) -> DataFrame:
    """Lists of nodes with an equal fragment: list, c, node, hub (the member with most in common with others), its degree.

    Any two nodes that link are together in a list. Keys are counted first, where they are made, and made
    once more with their nodes: then only those that occur twice are dealt out. No key is gathered in one
    task; lists with the same members are one, named by its members.
    """
    sizes = [n for n in range(1, 64) if t.apart(2 * n + 1) > 0]
    least = sizes[0] if sizes else 64  # smaller sets link only with equal ones

    # Most copies of equal sets are left out where they are read; the semi-join below drops the rest.
    spark = rows.sparkSession
    of_nodes = spark.sparkContext.broadcast(filter_of(nodes))
    rows = rows.withColumn("h", filter_place("doc_id", of_nodes.value))

    def keyed(shared: Broadcast | None) -> Callable:
        """Keys alone, or those that pass a filter of the shared ones, with their node and kind."""

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch[in_filter(of_nodes.value, batch["h"].to_numpy())]
                texts = batch["text"].tolist()
                for a, b in in_chunks(texts):
                    out = []
                    for node, s in zip(batch["doc_id"].iloc[a:b], shingle_sets(texts[a:b], width), strict=True):
                        for c in classes_of(len(s), t) if len(s) >= least else ():
                            k, spare = keys_of(s, c, t)
                            if shared is not None:
                                k = k[in_filter(shared.value, k & (8 * len(shared.value) - 1))]
                            out.append((k, np.full(len(k), node), np.full(len(k), spare << 6 | c, dtype=np.int32)))
                    if out:
                        key, node, kind = (np.concatenate(x) for x in zip(*out, strict=True))
                        yield pd.DataFrame({"key": key} if shared is None else {"node": node, "kind": kind, "key": key})

        return made

    often = cut(rows.mapInPandas(keyed(None), "key long").groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    shared = spark.sparkContext.broadcast(filter_of(often, "key", hashed=False))
    keys = rows.mapInPandas(keyed(shared), "node long, kind int, key long")
    # The most frequent go, as many as the set may leave out.
    own = Window.partitionBy("node", "kind").orderBy(F.desc("often"), F.desc("key"))
    rare = keys.join(often, "key").withColumn("at", F.row_number().over(own)).where(F.col("at") > F.shiftright("kind", 6))
    # Of equal sets only the node stays, and it has the least id.
    rare = cut(rare.join(nodes, "node", "left_semi").select("key", "often", F.col("kind").bitwiseAND(63).cast("byte").alias("c"), "node"))
    degrees = rare.groupBy("node").agg(F.sum("often").alias("degree"))
    rare = cut(rare.join(degrees, "node"))
    named = F.xxhash64(F.bit_xor(F.xxhash64("node")), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31))), F.first("c"))
    most = F.max(F.struct("degree", (-F.col("node")).alias("minus")))
    found = rare.groupBy("key").agg(named.alias("list"), F.min("node").alias("low"), F.max("node").alias("high"), most.alias("most")).where("low <> high")
    found = found.select("key", "list", (-F.col("most.minus")).alias("hub"), F.col("most.degree").alias("top"))
    met = rare.select("key", "c", "node").join(found, "key")
    return cut(met.groupBy("list", "node").agg(F.first("c").alias("c"), F.max("hub").alias("hub"), F.max("top").alias("degree")))


def _apart_still(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs with the components of both ends."""
    for end in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(end), F.col("component_id").alias(f"comp_{end}")), end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    return pairs


def _apart(total, t: Threshold):
    return F.floor(total * (t.den - t.num) / F.lit(t.den + t.num))


def in_parts(s: np.ndarray) -> list[np.ndarray]:
    """A sorted set cut into PARTS fragments of the order."""
    at = np.searchsorted(s, np.arange(1, PARTS, dtype=np.uint64) * np.uint64(2**64 // PARTS))
    return [x.view(np.int64) for x in np.split(s, at)]


#: Bits of the filter below for each id, and bits of any filter at least and at most: bounded, so it may be sent to every task.
BITS_AN_ID, LEAST_BITS, MOST_BITS = 12, 1 << 20, 1 << 28


def filter_place(c: str, bits: bytes) -> Column:
    """Where a filter (see filter_of) holds the id."""
    return F.pmod(F.xxhash64(c), F.lit(8 * len(bits)))


def filter_of(wanted: DataFrame, column: str = "node", hashed: bool = True) -> bytes:
    """A filter over a column of longs: all of them pass, and a few others; the more, the further their number is over MOST_BITS / BITS_AN_ID.

    hashed: a hash of the value tells its place; else its own lowest bits do.
    """
    n_bits = LEAST_BITS
    wish = BITS_AN_ID * wanted.count()
    while n_bits < min(wish, MOST_BITS):
        n_bits *= 2
    size = 1 << 15
    h = F.pmod(F.xxhash64(column) if hashed else F.col(column), F.lit(n_bits))
    parts = wanted.groupBy(F.floor(h / size).alias("k")).agg(F.bitmap_construct_agg(h % size).alias("bits")).toLocalIterator()  # MOST_BITS at most
    bits = bytearray(n_bits // 8)
    for r in parts:
        bits[r["k"] * size // 8 : r["k"] * size // 8 + len(r["bits"])] = r["bits"]
    return bytes(bits)


def in_filter(bits: bytes, at: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bits, dtype=np.uint8)
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by(rows: DataFrame, wanted: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """rows that may be in wanted (node), and rows that are surely not; null ids are in neither filter nor wanted."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(wanted))

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for at in batches:
            yield pd.Series(in_filter(shared.value, at.to_numpy()))

    marked = rows.withColumn("_hit", F.col(id_col).isNotNull() & hit(filter_place(id_col, shared.value)))
    return marked.where("_hit").drop("_hit"), marked.where("NOT _hit").drop("_hit")


def _sets(rows: DataFrame, wanted: DataFrame, t: Threshold, width: int) -> DataFrame:
    """Of the wanted nodes: node, n, x (of which text the set is, where rows share an id), its shingles by part of the
    order, and its marks in each of its classes.

    Texts are not shuffled: where they are read, a filter of bounded size passes the wanted rows, and
    some more; these are dropped by an exact semi-join of the results.
    """
    wanted = cut(wanted)
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[in_filter(shared.value, batch["h"].to_numpy())]
            texts = batch["text"].tolist()
            for a, b in in_chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                x = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                marks = [[{"c": c, "marks": marks_of(s, c, t)} for c in classes_of(len(s), t)] if len(s) else [] for s in sets]
                yield pd.DataFrame({"node": batch["doc_id"].iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "x": x, "parts": [in_parts(s) for s in sets], "marks": marks})

    schema = "node long, n int, x long, parts array<array<long>>, marks array<struct<c:byte,marks:array<long>>>"
    return rows.withColumn("h", filter_place("doc_id", shared.value)).mapInPandas(made, schema).join(wanted, "node", "left_semi")


def _bounded(pairs: DataFrame, marks: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (c, a, b) whose sizes and marks leave room for a link."""
    a = marks.select("c", F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    b = marks.select("c", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    met = pairs.join(b, ["c", "b"]).join(a, ["c", "a"])  # many pairs may share a: it comes last, where large partitions are split
    return met.where((t.den * F.least("na", "nb") >= t.num * F.greatest("na", "nb")) & (differing("ma", "mb") <= _apart(F.col("na") + F.col("nb"), t))).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Pairs that link: partial overlaps are counted per fragment of the order and summed per pair.

    Repeated rows of an id make every fragment count as often, so sums are divided by that; texts
    that share an id are counted each by itself.
    """
    whole = sets.select("node", "n", "x", F.posexplode("parts").alias("part", "tokens"))
    a = whole.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"), "part", F.col("tokens").alias("ta"))
    b = whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"), "part", F.col("tokens").alias("tb"))
    # The hub of many pairs is a: its side comes last, where large partitions are split.
    both = pairs.join(b, "b").join(a, ["a", "part"])
    times = F.count("*") / PARTS
    counted = both.groupBy("a", "b", "na", "nb", "xa", "xb").agg((F.sum(F.size(F.array_intersect("ta", "tb"))) / times).alias("common"))
    return cut(counted.where(t.den * F.col("common") >= t.num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))
