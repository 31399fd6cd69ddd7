"""Document fingerprints from prefix polynomial hashes.

H[i] = sum of c[j] * B^j for j < i, modulo a prime: one running sum per text. Two spans are equal
when their differences of H, brought to the same power, are; prefixes that agree stay equal up to
one place, so the longest common extension is found by binary search. A fingerprint keeps H on a
fixed geometric grid from either end and the least hashes of all spans of SPAN characters.
"""

from __future__ import annotations

import hashlib
import os.path
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import n_partitions, small_batches

#: Mersenne prime 2^31 - 1: products of two residues fit in 64 bits.
PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 69_069_069)
SPAN, KEPT, GRID = 24, 32, 1.25
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod PRIME, made by doubling and kept."""
    held = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(held) < n:
        held = np.concatenate((held, held * np.uint64(pow(base, len(held), int(PRIME))) % PRIME))
    _powers[base] = held
    return held[:n]


def points(text: str) -> np.ndarray:
    """Code points, each plus one, so that no character is a zero."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


class Prefixes:
    """The modular prefix arrays of one text."""

    def __init__(self, codes: np.ndarray, bases: tuple[int, ...] = BASES) -> None:
        self.n, self.bases = len(codes), bases
        self.at = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(b, len(codes)) % PRIME) % PRIME)) for b in bases]

    def prefix(self, n: int) -> int:
        """Hash of the first n characters."""
        return int(self.at[0][n]) << 31 | int(self.at[-1][n])

    def suffixes(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the last so many characters, whatever stands before them."""
        at, inverse = self.at[-1], powers(pow(self.bases[-1], -1, int(PRIME)), self.n + 1)
        return (at[self.n] + PRIME - at[self.n - ends]) % PRIME * inverse[self.n - ends] % PRIME

    def span(self, start: int, n: int) -> int:
        """Hash of a span, the same wherever it stands."""
        out = 0
        for base, at in zip(self.bases, self.at, strict=True):
            diff = (int(at[start + n]) - int(at[start])) % int(PRIME)
            back = pow(base, -start, int(PRIME)) if start else 1
            out = out << 31 | diff * back % int(PRIME)
        return out

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of `width` characters, in order; fewer characters: none."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        base, at = self.bases[0], self.at[0]
        inverse = powers(pow(base, -1, int(PRIME)), m)
        return (at[width : width + m] + PRIME - at[:m]) % PRIME * inverse % PRIME


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Characters that agree from place i of a and place j of b on, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    if a.span(i, high) == b.span(j, high):
        return high
    while low < high:
        n = (low + high + 1) // 2
        if a.span(i, n) == b.span(j, n):
            low = n
        else:
            high = n - 1
    return low


def grid(n: int) -> list[int]:
    """Fixed lengths 1, 2, 3, ... that are below n, in a geometric row from 4 on."""
    out, at = [], 1
    while at < n:
        out.append(at)
        at = max(at + 1, int(at * GRID))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes in an order that has nothing to do with the text."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def fingerprint(text: str) -> str:
    return fingerprint_of(Prefixes(points(text)))


def fingerprint_of(p: Prefixes) -> str:
    """`length:whole:prefixes:suffixes:spans` in hexadecimal; equal texts have equal ones."""
    ends = np.array(grid(p.n), dtype=np.int64)
    least = np.zeros(0, np.uint64)
    if len(all_ := mixed(p.spans(SPAN))):
        if len(all_) > 64 * KEPT:  # the least few without sorting all
            near = all_[all_ < (np.uint64(1) << np.uint64(32)) // np.uint64(max(1, len(all_) // (8 * KEPT)))]
            all_ = near if len(np.unique(near)) >= KEPT else all_
        least = np.unique(all_)[:KEPT]
    return ":".join((f"{p.n:x}", f"{p.prefix(p.n):016x}", short_hex(p.at[-1][ends]), short_hex(p.suffixes(ends)), "".join(f"{x:08x}" for x in least.tolist())))


def short_hex(hashes: np.ndarray) -> str:
    """Six digits each, of the low 24 bits."""
    return hashes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone; 1 if the texts are equal.

    The larger of two estimates: the share of the longer text that the common prefix and the
    common suffix make up (each found by binary search on the grid, to within its step), and the
    Jaccard index of the span sets from their least hashes.
    """
    if a == b:
        return 1.0
    n, _, pa, sa, ka = a.split(":")
    m, _, pb, sb, kb = b.split(":")
    n, m = int(n, 16), int(m, 16)
    short, long_ = min(n, m), max(n, m)
    if not short:
        return 0.0
    at = grid(short)

    def reach(x: str, y: str) -> int:
        k = bisect_right(range(len(at)), 0, key=lambda i: int(x[6 * i : 6 * i + 6] != y[6 * i : 6 * i + 6]))
        return at[k - 1] if k else 0

    ends = min(reach(pa, pb) + reach(sa, sb), short) / long_
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (ka, kb))
    least = sorted(x | y)[:KEPT]
    spans = sum(h in x and h in y for h in least) / len(least) if least else 0.0
    return max(ends, spans) * (1 - 1e-9)


def range_key(docs: DataFrame, order_col: str) -> Column:
    """A number in the order of the column, by which ranges are cut: of text, seven bytes behind what all values begin with."""
    key = F.col(order_col)
    if not isinstance(docs.schema[order_col].dataType, T.StringType):
        return key
    ends = docs.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    both = len(os.path.commonprefix([(ends["a"] or "").encode("utf-8", "surrogatepass"), (ends["b"] or "").encode("utf-8", "surrogatepass")]))
    return F.conv(F.rpad(F.substring(F.hex(key.cast("binary")), 2 * both + 1, 14), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, order_col: str, cells: int) -> tuple[DataFrame, int]:
    """Rows dealt so that each order range (`_cell`) stands in one partition, sorted by (_cell,
    _tail, order, text), with a copy of the following cell's first rows at its end (`_tail` = 1).

    Sent to the driver: quantiles and the least key of each of `cells` ranges. The text is
    shuffled once.
    """
    key = F.col(order_col)
    place = range_key(docs, order_col)
    bounds = docs.select(F.percentile_approx(place, [i / cells for i in range(1, cells)], 10 * cells).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds))
    # How many bounds are not above the key; null keys come first.
    held = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    cell = F.coalesce(F.when(key.isNull(), F.lit(-1)).otherwise(F.size(F.filter(held, lambda b: b <= place))), F.lit(-1))
    firsts = sorted((r["_cell"], r["_first"]) for r in docs.groupBy(cell.alias("_cell")).agg(F.min(key).alias("_first")).collect())
    # The first rows of a cell follow the last of the cell before it; those of the first cell, the last of all.
    heads = {firsts[i][0]: (firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))}
    tail = F.lit(None).cast("int")
    if heads:
        before = F.create_map(*[F.lit(x) for c, (b, _) in heads.items() for x in (c, b)])
        kind = docs.schema[order_col].dataType
        first = F.create_map(*[x for c, (_, f) in heads.items() for x in (F.lit(c), F.lit(f).cast(kind))])
        tail = F.when(key.isNull() | (key == first[F.col("_own")]), before[F.col("_own")])
    dealt = docs.withColumn("_own", cell)
    copies = F.array_compact(F.array(F.struct(F.col("_own").alias("c"), F.lit(0).alias("t")), F.when(tail.isNotNull(), F.struct(tail.alias("c"), F.lit(1).alias("t")))))
    dealt = dealt.withColumn("_to", F.explode(copies)).select(*docs.columns, F.col("_to.c").alias("_cell"), F.col("_to.t").alias("_tail"))
    return dealt.repartition(n_partitions(docs.sparkSession), "_cell").sortWithinPartitions("_cell", "_tail", F.col(order_col).asc_nulls_first(), "text"), len(firsts)


def edited(text: str, follower: str) -> str:
    """The last half of the characters replaced by the first as many (or all) of the follower."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, against the next document by ascending id (after the last: the first);
    same_edited, same_next: characters that it has in common with them from the first on.

    Null texts are empty; null ids come first; rows that share an id are ordered by text. A lone
    document follows itself. Ids are numbers or text; rows that share one are read by one task. Empty texts are like each other (1) and like nothing else (0). Whole
    texts are hashed; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt, _ = with_next(rows, "doc_id", cells or 4 * n_partitions(spark))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next")
    kinds = (kind, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType())

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row that waits for its follower, with its fingerprint
        for batch in batches:
            out = []
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for key, text, cell, tail in zip(ids, batch["text"], batch["_cell"], batch["_tail"], strict=True):
                if last is None and tail:
                    continue  # more copies of a first row than one
                hashes = Prefixes(points(text))
                mark = fingerprint_of(hashes)
                if last is not None and last[3] == cell:
                    new = edited(last[1], text)
                    changed = Prefixes(points(new))
                    other = fingerprint_of(changed)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    same = longest_common_extension(last[4], 0, changed, 0), longest_common_extension(last[4], 0, hashes, 0)
                    out.append((last[0], len(last[1]), sha, last[2], other, likeness(last[2], other), likeness(last[2], mark), *same))
                last = None if tail else (key, text, mark, cell, hashes)
            yield pd.DataFrame(out, columns=names).astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64", "same_edited": "int64", "same_next": "int64"})

    return dealt.mapInPandas(hashed, T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)]))
