"""Packing by power-of-two decomposition.

Each document's token ids (closed by an end id) are cut into pieces of binary length: as many of
the longest allowed length as fit, then one piece per set bit of what is left, longest first.
A sequence is one piece, so it never crosses documents and needs no padding. Pieces are put into
buckets of equal length, and a bucket is dealt out as rectangular batches.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import in_chunks, small_batches, starts_of

#: Ids of a batch of pieces of one length.
BATCH_TOKENS = 1 << 16
#: White space that the look-ahead of the pattern treats apart.
_DOUBLE = re.compile(r"\s\s")


class Ids:
    """Token ids of texts with the 50k byte-level vocabulary.

    The ranks file holds the same vocabulary as byte_bpe_50k.json; tests compare both. Since a
    token never reaches over a space, the distinct words of a batch are encoded once, in one call.
    of() takes added tokens' strings for ordinary text; whole() gives them their ids, as the
    tokenizer of the json does.
    """

    def __init__(self, ranks_path: str | None = None) -> None:
        import public_tokenizers as public
        import tiktoken

        with open(ranks_path or public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = make("exact", public.PATTERN)
        #: The look-ahead matters only where white space follows white space.
        self.plain = make("plain", public.PATTERN.replace(r"|\s+(?!\S)", ""))
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as held:
            self.added = {x["content"]: x["id"] for x in json.load(held)["added_tokens"]}
        #: The first that begins, of those the longest.
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Texts are parted at added tokens first, and what lies between is encoded by itself."""
        if self.marks is None:
            return self.of(texts)
        parts = [self.marks.split(x) for x in texts]  # text, added token, text, ...
        ids = iter(self.of([x for own in parts for x in own[::2]]))
        out = []
        for own in parts:
            pieces = [next(ids)]
            for mark in own[1::2]:
                pieces += [np.array([self.added[mark]], dtype="<u4"), next(ids)]
            out.append(np.concatenate(pieces) if len(pieces) > 1 else pieces[0])
        return out

    def of(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        words: list[str] = []
        spans: list[tuple[int, int, int]] = []
        for i, text in enumerate(texts):
            if not text or text[0].isspace() or text[-1].isspace() or _DOUBLE.search(text):
                out[i] = np.array(self.exact.encode_ordinary(text), dtype="<u4")
            else:
                own = text.split(" ")
                spans.append((i, len(words), len(own)))
                words += own
        if not words:
            return out
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        ids = np.array(self.plain.encode_ordinary(" " + " ".join(distinct)), dtype="<u4")
        begin = np.flatnonzero(self.opens[ids])
        size = np.diff(np.append(begin, len(ids)))
        lengths = size[codes]
        to = starts_of(lengths)
        flat = ids[np.repeat(begin[codes] - to, lengths) + np.arange(lengths.sum())]
        ends = np.append(to, len(flat))
        for i, at, n in spans:
            # The first word has no space before it.
            first = np.array(self.plain.encode_ordinary(words[at]), dtype="<u4")
            out[i] = np.concatenate((first, flat[ends[at + 1] : ends[at + n]]))
        return out


def lengths_of(total: int, longest: int) -> list[int]:
    """total as lengths that are powers of two, at most `longest`, which is one too; longest first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Buckets:
    """Deals pieces of equal length into batches; the number of a batch tells its partition, its bucket and its place there."""

    def __init__(self, partition: int, batch_tokens: int) -> None:
        self.partition, self.batch_tokens, self.held = partition, batch_tokens, Counter()

    def batch_of(self, length: int) -> int:
        bucket = length.bit_length() - 1
        place = self.held[bucket] // max(1, self.batch_tokens // length)
        self.held[bucket] += 1
        return self.partition << 40 | bucket << 34 | place


def pack(docs: DataFrame, *, longest: int = 1024, end_id: int = 0, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch_id[, ids].

    Pieces with one batch_id have one length and hold batch_tokens ids together (at least one piece).
    Buckets are filled where rows are read, so no bucket meets in one task; only the last batch of
    each bucket of a partition may be short.

    Null and empty texts give one piece that holds the end id. A row that stands twice is packed
    twice. Only the two named columns are read; ids may be null or repeat. No shuffle: pieces are
    cut where the rows are read, and memory is bounded by a batch and the longest text.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("batch_id", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, buckets = Ids(ranks_path), Buckets(TaskContext.get().partitionId(), batch_tokens)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            keys = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            texts = ["" if x is None else x for x in batch["text"].tolist()]
            for a, b in in_chunks(texts):
                rows = []
                for key, ids in zip(keys[a:b], encoder.whole(texts[a:b]), strict=True):
                    ids = np.concatenate((ids, end))
                    at = 0
                    for n in lengths_of(len(ids), longest):
                        piece = ids[at : at + n]
                        rows.append((key, at, n, zlib.crc32(piece), len(ids), buckets.batch_of(n), *([piece.astype("i4")] if keep_ids else [])))
                        at += n
                yield pd.DataFrame(rows, columns=schema.names)

    pieces = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut_up, schema)
    # The rows come from a scan or a written table, so partitions and ids agree when a task is retried.
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "batch_id", *(["ids"] if keep_ids else []))
