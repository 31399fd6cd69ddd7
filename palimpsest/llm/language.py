"""Language identification for mixed text.

The script of a word (from the code ranges of its letters) narrows the languages that it may be
in. Every word gets a score per candidate from its byte trigrams and from itself, and a Viterbi
pass with a penalty for every change of language labels the words. Runs of one label are spans.
The document's language is the one that opens it if that holds at least a share of the letters
which is learned from the labelled rows, else the one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import in_chunks, made_in_a_task, small_batches
from palimpsest.llm.words import Words, buckets

UNKNOWN = "und"
BITS = 16
PENALTY = 12.0
#: Labelled rows of each language that training reads at most.
SAMPLE = 1000
#: Characters of training text that are counted together.
TRAIN_CHARS = 1 << 18
#: A word outside its script's languages scores so much less for each.
OUTSIDE = -30.0
#: Characters of text whose labels are found together.
MOST_CHARS = 1 << 23

# Scripts and the code points of their letters. Fixed values.
SCRIPTS = (
    ("latin", (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    ("armenian", (0x530, 0x58F)),
    ("hebrew", (0x590, 0x5FF)),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("devanagari", (0x900, 0x97F)),
    ("bengali", (0x980, 0x9FF)),
    ("other indic", (0xA00, 0xDFF)),
    ("thai and lao", (0xE00, 0xEFF)),
    ("tibetan and burmese", (0xF00, 0x109F)),
    ("georgian", (0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    ("ethiopic", (0x1200, 0x139F)),
    ("khmer", (0x1780, 0x17FF)),
    ("kana", (0x3040, 0x30FF), (0x31F0, 0x31FF)),
    ("han", (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)),
)
_SIGN = np.zeros(256, dtype=np.uint32)
_SIGN[97:123] = np.arange(97, 123)
_SIGN[128:] = np.arange(128, 256)


def _script_table() -> np.ndarray:
    """[first byte, low six bits of the second] of a letter's UTF-8 form -> place in SCRIPTS; all else: one more."""
    out = np.full((256, 64), len(SCRIPTS), dtype=np.int64)
    for k, (_, *ranges) in enumerate(SCRIPTS):
        for low, high in ranges:
            # So many code points share their first two bytes.
            step = 1 if low < 0x800 else 64 if low < 0x10000 else 4096
            for code in range(low, high + 1, step):
                own = chr(code).encode("utf-8", "surrogatepass")
                out[own[0], own[1] & 63 if len(own) > 1 else slice(None)] = k
    return out


_SCRIPT = _script_table()


def grams(w: Words) -> np.ndarray:
    """For every byte, the bucket of the trigram around it; what parts words counts as one sign."""
    own = np.zeros(len(w.data) + 2, dtype=np.uint32)
    own[1:-1] = _SIGN[w.data]
    return ((own[:-2] * np.uint32(0x9E3779B1) + own[1:-1] * np.uint32(0x85EBCA6B) + own[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)


def per_word(values: np.ndarray, w: Words) -> np.ndarray:
    """Sums over the bytes of each word."""
    return np.add.reduceat(values, np.column_stack((w.starts, w.ends)).ravel())[::2]


def scripts(w: Words) -> np.ndarray:
    return _SCRIPT[w.data[w.starts], w.data[w.starts + 1] & 63]


@dataclass
class Model:
    names: list[str]
    gram: np.ndarray  # [languages, buckets]
    word: np.ndarray  # [buckets, languages]
    allowed: np.ndarray  # [scripts, languages]
    opening: float = 0.5

    def emissions(self, w: Words) -> np.ndarray:
        """Scores [words, languages]."""
        if not len(w.starts):
            return np.zeros((0, len(self.names)), np.float32)
        g = grams(w)
        out = np.stack([per_word(table[g], w) for table in self.gram], axis=1)
        out += self.word[buckets(w.hashes(w.starts, w.ends), 2, BITS)]
        script = scripts(w)
        return out + self.allowed[script]

    def label(self, texts: list[str], penalty: float = PENALTY) -> Labelled:
        """Scores are made for about a million characters at a time, the labels for all together."""
        parts, scores = [], []
        for a, b in in_chunks(texts, 1 << 20):
            w = Words(texts[a:b])
            place = np.cumsum((w.data & 0xC0) != 0x80) - 1  # which character a byte belongs to
            begin = place[w.text_at[:-1]][np.repeat(np.arange(b - a), np.diff(w.first))]
            parts.append((w.ends - w.starts, place[w.starts] - begin, place[w.ends - 1] + 1 - begin, np.diff(w.first)))
            scores.append(self.emissions(w))
        letters, start, end, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.concatenate(([0], np.cumsum(words)))
        return Labelled(letters, start, end, first, viterbi(np.concatenate(scores), first, penalty), len(self.names))


@dataclass
class Labelled:
    """Words of many texts: letters (bytes), first and last character, label; first: of each text, its first word."""

    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    labels: np.ndarray
    k: int

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's letters in each language; the label of its first word."""
        n = len(self.first) - 1
        owner = np.repeat(np.arange(n), np.diff(self.first))
        letters = np.bincount(owner * self.k + self.labels, weights=self.letters, minlength=n * self.k).reshape(n, self.k)
        opening = np.append(self.labels, 0)[np.minimum(self.first[:-1], len(self.labels))].astype(np.int64)
        return letters / np.maximum(1, letters.sum(axis=1, keepdims=True)), opening


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row; rows first[i]:first[i + 1] are one text; a change costs `penalty`.

    Most texts keep one label; where that is proven best, no steps are needed. The others take
    each step together, the longest first, so those that have ended drop off the end.
    """
    n, k = scores.shape
    out = np.zeros(n, dtype=np.int32)
    lengths = np.diff(first)
    order = np.flatnonzero(lengths > 0)
    if not len(order):
        return out
    one, sure = constant(scores, first[:-1][order], penalty)
    out[:] = np.repeat(one, lengths[order])
    order = order[~sure]
    if not len(order):
        return out
    order = order[np.argsort(-lengths[order], kind="stable")]
    begin, left = first[:-1][order], lengths[order]
    # alive[t]: how many texts have a row t.
    alive = np.searchsorted(-left, -np.arange(left[0]), side="left")
    stay = np.zeros((n, k), dtype=bool)
    best = np.zeros(n, dtype=np.int32)
    v = np.zeros((len(order), k), dtype=np.float64)
    for t in range(left[0]):
        m = alive[t]
        v = v[:m]
        rows = begin[:m] + t
        v = np.maximum(v, -penalty) + scores[rows]
        top = v.argmax(axis=1)
        v -= v[np.arange(m), top][:, None]
        best[rows] = top
        stay[rows] = v > -penalty  # for the next row: whether it keeps this label or comes from the best
    now = best[begin + left - 1].copy()
    # Backwards, texts join as their last row is reached.
    cur = now.astype(np.int64)
    for t in range(left[0] - 1, -1, -1):
        m = alive[t]
        rows = begin[:m] + t
        if t + 1 < left[0]:
            more = alive[t + 1]
            keep = stay[rows[:more], cur[:more]]
            cur[:more] = np.where(keep, cur[:more], best[rows[:more]])
        out[rows] = cur[:m]
    return out


def constant(scores: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single label of each text, and whether no path with changes can beat it.

    A run in another label gains at most the largest sum of differences over any run of rows. A
    path with k such runs has k changes, or k - 1 if it never takes the best label; so if no run
    gains more than half a penalty, k gains never exceed k - 1 penalties for k > 1, and one label
    throughout gains nothing.
    """
    one = np.add.reduceat(scores, first, axis=0).argmax(axis=1)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(scores))))
    own = scores[np.arange(len(scores)), one[owner]]
    sure = np.ones(len(first), dtype=bool)
    for m in range(scores.shape[1]):
        diff = (scores[:, m] - own).astype(np.float64)
        total = np.cumsum(diff)
        before = total - diff
        # Each text stands lower than all before it, so the running least starts anew.
        drop = owner * (2 * np.abs(total).max() + 1)
        least = np.minimum.accumulate(before - drop)
        sure &= np.maximum.reduceat(total - drop - least, first) <= penalty / 2
    return one, sure


def train(texts: list[str], langs: list[str], *, smooth: float = 0.5) -> Model:
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    size, k = 1 << BITS, len(names)
    gram, word, seen = np.zeros((k, size)), np.zeros((k, size)), np.zeros((k, len(SCRIPTS) + 1))
    for a, b in in_chunks(texts, TRAIN_CHARS):
        w = Words(texts[a:b])
        if not len(w.starts):
            continue
        lang = np.array([code[x] for x in langs[a:b]])
        of_word = np.repeat(lang, np.diff(w.first))
        g = grams(w)
        of_gram = np.full(len(g), -1)
        inside = np.repeat(w.starts, w.ends - w.starts) + np.arange(len(of_word) and (w.ends - w.starts).sum()) - np.repeat(np.cumsum(w.ends - w.starts) - (w.ends - w.starts), w.ends - w.starts)
        of_gram[inside] = np.repeat(of_word, w.ends - w.starts)
        hashed, script = buckets(w.hashes(w.starts, w.ends), 2, BITS), scripts(w)
        for i in range(k):
            gram[i] += np.bincount(g[of_gram == i], minlength=size)
            word[i] += np.bincount(hashed[of_word == i], minlength=size)
            seen[i] += np.bincount(script[of_word == i], minlength=len(SCRIPTS) + 1)

    def logs(counts: np.ndarray, most: float) -> np.ndarray:
        p = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * size))
        p -= p.mean(axis=0)
        return np.clip(p.T, -most, most).astype(np.float32)

    share = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
    allowed = np.where(share.T >= 1e-3, 0.0, OUTSIDE)
    allowed[(allowed < 0).all(axis=1)] = 0.0  # a script that no language uses says nothing
    model = Model(names, np.ascontiguousarray(logs(gram, 2.0).T), logs(word, 3.0), allowed.astype(np.float32))
    return opened(model, texts, langs)


def opened(model: Model, texts: list[str], langs: list[str]) -> Model:
    """Learn from which share of the letters on the language that opens a text is the text's."""
    shares, firsts = [], []
    for a, b in in_chunks(texts, 4 * TRAIN_CHARS):
        share, first = model.label(texts[a:b]).shares()
        shares.append(share)
        firsts.append(first)
    share, first = np.concatenate(shares), np.concatenate(firsts)
    true = np.array([model.names.index(x) for x in langs])
    steps = np.arange(10, 0, -1) / 20
    hits = [(np.where(share[np.arange(len(first)), first] >= s, first, share.argmax(axis=1)) == true).sum() for s in steps]
    model.opening = float(steps[int(np.argmax(hits))])
    return model


def fit_languages(docs: DataFrame, *, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on at most `sample` rows of each language, the first by a hash of id and text among a share
    of all rows that is drawn by it; repeated rows count once. None if there is no labelled row.

    One task trains on `sample` texts of each language at most. Sent to the driver: a row per language, and the model.
    """
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own if learn is None else own.where(learn)
    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(23))
    sizes = {r[0]: max(1, r[1]) for r in own.groupBy(lang_col).agg(F.approx_count_distinct(place)).collect()}  # one row per language
    if not sizes:
        return None
    # A share of each language a little above the sample; the rest is cut off by rank.
    hashed = F.pmod(place, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * sample / n))]), F.col(lang_col))
    drawn = own.where(hashed < share).select(F.col(lang_col).alias("_lang"), place.alias("_place"), F.col(text_col).alias("_text"))
    drawn = drawn.groupBy("_lang", "_place").agg(F.first("_text").alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_place"))
    rows = drawn.withColumn("_at", rank).where(F.col("_at") <= sample).select("_text", "_lang", "_place")

    def trained(held: pd.DataFrame) -> Model:
        held = held.sort_values(["_lang", "_place"])
        return train(held["_text"].tolist(), held["_lang"].tolist())

    return made_in_a_task(rows, trained)


SPANS = "array<struct<start:long,length:long,lang:string>>"


def identify(docs: DataFrame, model: Model | None, *, penalty: float = PENALTY, text_col: str = "text", with_spans: bool = True, with_largest: bool = False) -> DataFrame:
    """docs with lang_pred, score (share of the letters in that language, 0 to 1)[, lang_spans][, largest_share].

    largest_share is that of the language with the most letters, which need not be lang_pred.

    A text that is null or has no letter is `und` with score 0, as is every text without a model.
    Spans give start and length in characters of the lower-cased text from the first to the last
    word of a run. Ties go to the first language by name. Columns of these names are replaced.
    Whole texts are labelled where they are read, without a shuffle.
    """
    kept = small_batches(docs).drop("lang_pred", "score", "lang_spans", *(["largest_share"] if with_largest else []))
    kind = "struct<lang:string,score:double,largest:double" + (f",spans:{SPANS}>" if with_spans else ">")
    if model is None:
        out = kept.withColumn("_is", F.lit(None).cast(kind))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: see BITS

        def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                texts = ["" if x is None else x for x in batch.tolist()]
                parts = [named(own, texts[a:b], penalty, with_spans) for a, b in in_chunks(texts, MOST_CHARS)]
                yield pd.concat(parts) if parts else pd.DataFrame({"lang": [], "score": [], "largest": []})

        # So declared, it is not run once more for every filter on its result.
        out = kept.withColumn("_is", F.pandas_udf(labelled, kind).asNondeterministic()(F.coalesce(text_col, F.lit(""))))
    known = F.col(text_col).rlike(r"\p{L}") & F.col("_is.lang").isNotNull()
    out = out.withColumn("lang_pred", F.when(known, F.col("_is.lang")).otherwise(F.lit(UNKNOWN)))
    out = out.withColumn("score", F.when(known, F.col("_is.score")).otherwise(F.lit(0.0)))
    if with_largest:
        out = out.withColumn("largest_share", F.when(known, F.col("_is.largest")).otherwise(F.lit(0.0)))
    if with_spans:
        out = out.withColumn("lang_spans", F.when(known, F.col("_is.spans")).otherwise(F.array().cast(SPANS)))
    return out.drop("_is")


def named(model: Model, texts: list[str], penalty: float, with_spans: bool) -> pd.DataFrame:
    words = model.label(texts, penalty)
    share, first = words.shares()
    row = np.arange(len(texts))
    main = np.where(share[row, first] >= model.opening, first, share.argmax(axis=1))
    out = pd.DataFrame({"lang": np.array(model.names, dtype=object)[main], "score": share[row, main], "largest": share.max(axis=1)})
    if with_spans:
        spans: list = [[] for _ in texts]
        owner = np.repeat(row, np.diff(words.first))
        change = np.flatnonzero((np.diff(words.labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        for a, b in zip(change, [*change[1:], len(owner)] if len(change) else [], strict=True):
            spans[owner[a]].append({"start": int(words.start[a]), "length": int(words.end[b - 1] - words.start[a]), "lang": model.names[words.labels[a]]})
        out["spans"] = spans
    return out
