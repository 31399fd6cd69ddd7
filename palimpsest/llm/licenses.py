"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how many documents of the whole table hold them, the rarest first. A template
of n tokens of which a block must hold o needs one of its first n - o + 1 tokens in the block; an
index of those, with their places, names candidates, and length and place bound what they can share.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches
from palimpsest.llm.words import terms

# Phrases, and wordings of public license notices with the labels they stand for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Licensed under the BSD License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A block meets a template when it holds this many percent of the template's distinct words.
LEAST = 90
#: Templates and phrases of more bytes in all are refused: they are sent to every task.
MOST_BYTES = 64 << 20

SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,template:int,start:long,length:long,overlap:int,containment:double>>"

NAMES = [c.split()[0] for c in SCAN.split(", ")]


def words_of(text: str | None) -> list[bytes]:
    return [w for part in terms(text) for w in part]


def step_of(n_words: int) -> int:
    """Blocks for a template of so many words begin at multiples of this and are twice as long, so the template lies whole in one."""
    return max(8, 1 << (n_words - 1).bit_length())


@dataclass
class Template:
    label: str
    tokens: np.ndarray  # distinct, as ranks, ascending: the rarest first
    least: int  # of them in a block


class Index:
    """Templates by their rarest tokens. Ranks: the rarer, the smaller; ties by the token itself."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], counts: dict[bytes, int], least: int) -> None:
        texts = [words_of(t) for _, t in templates]
        said = [words_of(p) for p, _ in phrases]
        self.rank = {t: i for i, t in enumerate(sorted({t for x in texts + said for t in x}, key=lambda t: (counts.get(t, 0), t)))}
        self.templates: list[Template] = []
        #: For each step: prefix token -> (template, place of the token in it).
        self.steps: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for (label, _), words in zip(templates, texts, strict=True):
            # A template without words meets nothing, and keeps its number.
            own = np.unique(np.array([self.rank[w] for w in words], np.int32))
            o = max(1, -(-least * len(own) // 100))
            self.templates.append(Template(label, own, o))
            for i, t in enumerate(own[: len(own) - o + 1].tolist() if len(own) else ()):
                self.steps[step_of(len(words))][t].append((len(self.templates) - 1, i))
        self.steps = {s: dict(x) for s, x in self.steps.items()}
        self.phrases = [(np.array([self.rank[w] for w in x], np.int32), label) for x, (_, label) in zip(said, phrases, strict=True) if x]

    def ids(self, text: str | None) -> np.ndarray:
        """Ranks of all words of the text; -1 for a word that no template or phrase holds."""
        get = self.rank.get
        parts = [np.fromiter((get(w, -1) for w in part), np.int32, len(part)) for part in terms(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def places(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Where each phrase's words stand consecutively."""
        out = []
        for words, label in self.phrases:
            n = len(ids) - len(words) + 1
            at = np.flatnonzero(ids[: max(n, 0)] == words[0])
            for k, w in enumerate(words[1:].tolist(), 1):
                at = at[ids[at + k] == w]
            out.append((label, at))
        return out

    def blocks(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start, length, overlap) of every block that holds enough of a template."""
        pos = np.flatnonzero(ids >= 0)
        tok = ids[pos]
        out = []
        for step, prefix in self.steps.items():
            hit = pos[np.isin(tok, list(prefix))] // step
            for w in np.unique(np.concatenate((hit, hit[hit > 0] - 1))).tolist():
                lo, hi = np.searchsorted(pos, (w * step, (w + 2) * step))
                own = np.unique(tok[lo:hi])
                tried = set()
                for j, t in enumerate(own.tolist()):
                    for k, i in prefix.get(t, ()):
                        o, n = self.templates[k].least, len(self.templates[k].tokens)
                        # Length; then what can still be shared from this first shared place on, which bounds the block's prefix too.
                        if k in tried or len(own) < o:
                            continue
                        tried.add(k)
                        if 1 + min(n - i - 1, len(own) - j - 1) < o:
                            continue
                        both = int(np.isin(self.templates[k].tokens, own, assume_unique=True).sum())
                        if both >= o:
                            out.append((k, w * step, min(2 * step, len(ids) - w * step), both))
        return sorted(out)


def token_counts(docs: DataFrame, tokens: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Number of documents that hold each token; at most one row per token leaves Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here.update({w for part in terms(text) for w in tokens.intersection(part)})
        yield pa.RecordBatch.from_pydict({"token": pa.array(here.keys(), pa.binary()), "n": pa.array(here.values(), pa.int64())})

    found = small_batches(docs.select(text_col)).mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in found.collect()}


def scan(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and blocks; columns of these names are replaced.

    Base: places of the phrases; first_word and last_word are their least and greatest starts (null
    without any), base_labels their distinct labels in order, comma-joined. blocks: every run of
    twice a template's length (as a power of two, 16 words at least), begun at every half of that,
    which holds at least `least` percent of the template's distinct words. labels are those of both.
    score: 1 with a phrase, else the highest containment of a block, else 0.

    Null and empty texts have no words and empty labels; an empty table gives an empty one; repeated
    rows are scanned each. Texts are read whole, a megabyte of words at a time, where they stand:
    only counts of the templates' own words are shuffled. Templates and phrases of over MOST_BYTES are refused.
    """
    if sum(len(a) + len(b) for a, b in (*templates, *phrases)) > MOST_BYTES:
        raise ValueError("too many templates to send to every task")
    kept = small_batches(docs).drop(*NAMES)
    counts = token_counts(docs, {t for _, x in templates for t in words_of(x)}, text_col)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases, counts, least))

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([found(index.value, text) for text in batch], columns=NAMES, dtype=object)

    # So declared, it is not run once more for every use of its result.
    scanner = F.pandas_udf(scanned, f"struct<{SCAN}>").asNondeterministic()
    return kept.withColumn("_scan", scanner(F.coalesce(text_col, F.lit("")))).select(*[f"`{c}`" for c in kept.columns], "_scan.*")


def found(index: Index, text: str) -> tuple:
    """The columns of SCAN for one text."""
    ids = index.ids(text)
    places = index.places(ids)
    starts = np.concatenate([at for _, at in places]) if places else np.zeros(0, np.int64)
    blocks = [{"label": index.templates[k].label, "template": k, "start": a, "length": n, "overlap": both, "containment": both / len(index.templates[k].tokens)} for k, a, n, both in index.blocks(ids)]
    base = {label for label, at in places if len(at)}
    score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
    ends = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
    return (len(ids), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks)
