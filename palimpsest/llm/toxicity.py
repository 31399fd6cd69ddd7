"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4, 5 and 6 bytes. Filters of
several widths run over the words; per filter the two largest responses of the whole text are
kept (max pooling; the second tells one slip from many) and weighed to a logit. Thresholds are
calibrated by language on labelled texts that training leaves out; the language is guessed from
the words, and the logit is shifted so that every language's threshold falls on CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, in_chunks, made_in_a_task, small_batches
from palimpsest.llm.words import Words, buckets

CUT = 0.7
BITS, DIM, FILTERS, WIDTHS, TOP = 16, 12, 8, (1, 2, 3), 2
PREFIXES = (0, 4, 5, 6)
#: Offsets (width, place in it), one table of responses each.
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
PAD = 1 << BITS  # the row of zeros behind every text
#: Labelled rows of each class that training reads at most.
SAMPLE = 1200
#: Characters of training text that are turned into features together.
TRAIN_CHARS = 1 << 18


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets [words, 4] of all texts, each text followed by pads; first row of each text."""
    w = Words(texts)
    n, pads = len(w.starts), max(WIDTHS) - 1
    at = np.arange(n) + pads * (np.searchsorted(w.first, np.arange(n), side="right") - 1)
    out = np.full((n + pads * len(texts), len(PREFIXES)), PAD, dtype=np.int64)
    for k, p in enumerate(PREFIXES):
        ends = np.minimum(w.ends, w.starts + p) if p else w.ends
        out[at, k] = buckets(w.hashes(w.starts, ends), 7919 * k, BITS)
    return out, w.first[:-1] + pads * np.arange(len(texts))


def responses(table: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Filter responses [words, widths * FILTERS]; table: [buckets + 1, slots * FILTERS]."""
    each = table[idx[:, 0]]
    for k in range(1, idx.shape[1]):
        each += table[idx[:, k]]
    out = np.zeros((len(idx), len(WIDTHS) * FILTERS), dtype=table.dtype)
    for s, (w, j) in enumerate(SLOTS):
        k = WIDTHS.index(w)
        out[: len(idx) - j, k * FILTERS : (k + 1) * FILTERS] += each[j:, s * FILTERS : (s + 1) * FILTERS]
    return out


def pads(first: np.ndarray, n: int) -> np.ndarray:
    """The rows behind the words of each text."""
    ends = np.append(first[1:], n)
    return np.concatenate([ends - k for k in range(1, max(WIDTHS))])


def pooled(table: np.ndarray, bias: np.ndarray, idx: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP largest responses [texts, TOP * filters], not below 0, and their words."""
    r = responses(table, idx)
    r[pads(first, len(idx))] = 0  # what stands behind the pads is another text
    r += bias
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(idx))))
    values, places = [], []
    for _ in range(TOP):
        most = np.maximum.reduceat(r, first, axis=0)
        rows, cols = np.nonzero(r == most[owner])
        # The first word that reaches the maximum.
        _, at = np.unique(owner[rows] * r.shape[1] + cols, return_index=True)
        place = rows[at].reshape(most.shape)
        r[place, np.arange(r.shape[1])] = -np.inf
        values.append(np.maximum(most, 0))
        places.append(place)
    return np.concatenate(values, axis=1), np.concatenate(places, axis=1)


@dataclass
class Model:
    table: np.ndarray  # [buckets + 1, slots * FILTERS], half precision
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    language: np.ndarray  # [buckets + 1, languages]: log shares of the words
    shift: np.ndarray  # by language

    def scores(self, texts: list[str]) -> np.ndarray:
        idx, first = features(texts)
        pool, _ = pooled(self.table.astype(np.float32) if self.table.dtype != np.float32 else self.table, self.bias, idx, first)
        logit = pool @ self.weights + self.offset
        if len(self.shift):
            logit = logit + self.shift[np.add.reduceat(self.language[idx[:, 0]], first, axis=0).argmax(axis=1)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _language_table(idx: list[np.ndarray], langs: list, names: list) -> np.ndarray:
    counts = np.full((PAD + 1, len(names)), 0.5)
    for one, lang in zip(idx, langs, strict=True):
        if lang in names:
            np.add.at(counts[:, names.index(lang)], one[:, 0][one[:, 0] != PAD], 1)
    out = np.log(counts / counts.sum(axis=0))
    out[PAD] = 0
    return out.astype(np.float32)


#: Weight of the squared weights in the loss, halved.
DECAY = 1e-4


def gradients(emb: np.ndarray, filt: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float, idx: np.ndarray, first: np.ndarray, y: np.ndarray, weight_of: np.ndarray) -> tuple:
    """Of the weighed mean log loss of a batch: the buckets used, and by their embeddings, filters, biases, weights, offset."""
    columns = np.arange(len(bias))
    used, local = np.unique(idx, return_inverse=True)
    local = local.reshape(idx.shape)
    pool, place = pooled((emb[used] @ filt).astype(emb.dtype), bias, local, first)
    p = 1 / (1 + np.exp(-np.clip(pool @ weights + offset, -30, 30)))
    err = ((p - y) * weight_of / len(y)).astype(emb.dtype)
    g_pool = err[:, None] * weights * (pool > 0)
    g_w = pool.T @ err + DECAY * weights
    g_bias, g_filt, g_emb = np.zeros_like(bias), np.zeros_like(filt), np.zeros((len(used), emb.shape[1]), emb.dtype)
    is_pad = np.zeros(len(idx), dtype=bool)
    is_pad[pads(first, len(idx))] = True
    for t in range(TOP):
        g, where = g_pool[:, t * len(bias) : (t + 1) * len(bias)], place[:, t * len(bias) : (t + 1) * len(bias)]
        g_bias += g.sum(axis=0)
        g = np.where(is_pad[where], 0, g)
        for s, (w, j) in enumerate(SLOTS):
            k = WIDTHS.index(w)
            cols = columns[k * FILTERS : (k + 1) * FILTERS]
            rows = np.minimum(where[:, cols] + j, len(idx) - 1)
            gs, fs = g[:, cols], slice(s * FILTERS, (s + 1) * FILTERS)
            for f in range(idx.shape[1]):
                b = local[rows, f]
                g_filt[:, fs] += np.einsum("tk,tkd->dk", gs, emb[used[b]])
                np.add.at(g_emb, b.ravel(), (gs[:, :, None] * filt[:, fs].T[None]).reshape(-1, emb.shape[1]))
    return used, g_emb, g_filt, g_bias, g_w, float(err.sum())


def train(texts: list[str], toxic: np.ndarray, langs: list, *, epochs: int = 4, rate: float = 0.05, batch: int = 64, seed: int = 7) -> Model:
    """Fit on four of five texts, calibrate on the rest. Texts in a fixed order give a fixed model."""
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, dtype=np.float64)
    parts = []
    for a, b in in_chunks(texts, TRAIN_CHARS):
        idx, first = features(texts[a:b])
        parts += np.split(idx.astype(np.int32), first[1:])
    names = sorted({x for x in langs if x is not None})
    back = np.arange(len(texts)) % 5 == 4
    fit_on = np.flatnonzero(~back)

    # Start: the log odds of each bucket over texts stand in the first dimension.
    seen = np.ones((PAD + 1, 2))
    for i in fit_on:
        own = np.unique(parts[i])
        seen[own, int(y[i])] += 1
    share = seen / (np.array([(y[fit_on] == 0).sum(), (y[fit_on] == 1).sum()]) + 2)
    emb = rng.normal(0, 0.05, (PAD + 1, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(np.log(share[:, 1] / share[:, 0]), -1, 3) * 0.3
    emb[PAD] = 0
    filt = rng.normal(0, 0.3, (DIM, len(SLOTS) * FILTERS)).astype(np.float32)
    filt[0] = np.abs(filt[0])
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    weights = np.full(TOP * len(bias), 0.1, np.float32)
    offset = -1.0
    sq = [np.full_like(x, 1e-6) for x in (filt, bias, weights)]
    sq_emb, sq_off = np.full(PAD + 1, 1e-6, np.float32), 1e-6
    # Classes weigh alike.
    weight_of = np.where(y == 1, 0.5 / max(1, (y[fit_on] == 1).sum()), 0.5 / max(1, (y[fit_on] == 0).sum())) * len(fit_on)
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        order = rng.permutation(fit_on)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            idx = np.concatenate([parts[i] for i in own])
            first = np.concatenate(([0], np.cumsum([len(parts[i]) for i in own])))[:-1]
            used, g_emb, g_filt, g_bias, g_w, g_off = gradients(emb, filt, bias, weights, offset, idx, first, y[own], weight_of[own])
            for x, gx, q in ((filt, g_filt, sq[0]), (bias, g_bias, sq[1]), (weights, g_w, sq[2])):
                q += gx * gx
                x -= step * gx / np.sqrt(q)
            sq_off += g_off**2
            offset -= step * g_off / sq_off**0.5
            sq_emb[used] += (g_emb**2).mean(axis=1)
            emb[used] -= step * g_emb / np.sqrt(sq_emb[used])[:, None]
            emb[PAD] = 0
    model = Model((emb @ filt).astype(np.float16), bias, weights, offset, _language_table(parts, langs, names), np.zeros(len(names)))
    return _calibrated(model, [texts[i] for i in np.flatnonzero(back)], y[back], names)


def best_threshold(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """In the middle of the gap at which the weighed errors are fewest."""
    order = np.argsort(logits)
    z, w = logits[order], np.where(y[order] == 1, weights[order], -weights[order])
    # Errors if all from place i on are called toxic, but for a constant.
    errors = np.concatenate(([0.0], np.cumsum(w)))
    edges = np.concatenate(([z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]))
    least = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edges[least[len(least) // 2]])


def _calibrated(model: Model, texts: list[str], y: np.ndarray, names: list) -> Model:
    """Shift the logits so that each language's best threshold, if it has enough rows of both labels, is CUT."""
    if not 0 < y.sum() < len(y):
        return model
    aim, table = float(np.log(CUT / (1 - CUT))), model.table.astype(np.float32)
    logits, guess = np.zeros(len(y)), np.zeros(len(y), dtype=np.int64)
    for a, b in in_chunks(texts, TRAIN_CHARS):
        idx, first = features(texts[a:b])
        logits[a:b] = pooled(table, model.bias, idx, first)[0] @ model.weights + model.offset
        if names:
            guess[a:b] = np.add.reduceat(model.language[idx[:, 0]], first, axis=0).argmax(axis=1)
    ones = np.ones(len(y))
    model.shift = np.full(max(1, len(names)), aim - best_threshold(logits, y, ones))
    for k in range(len(names)):
        own = guess == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= 10:
            model.shift[k] = aim - best_threshold(logits[own], y[own], ones[own])
    if not names:
        model.language = np.zeros((PAD + 1, 1), np.float32)
    return model


def remainder(id_col: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id: 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(by)), F.lit(0)).cast("int")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model | None:
    """Train on at most `sample` labelled rows of each class, the first by a hash of the id.

    learn: which rows of labels may be learned from. A document with several labels is toxic if
    any says so; of several texts the least counts; null labels, ids without a document and null texts
    are passed over. Without both classes there is nothing to learn: None. One task trains on 2 * sample texts
    at most; the model goes to the driver.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = (own if learn is None else own.where(learn)).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y"))
    order = F.xxhash64("_id", F.lit(11)), F.col("_id")
    picked = own.where("_y = 1").orderBy(*order).limit(sample).union(own.where("_y = 0").orderBy(*order).limit(sample))
    # At most 2 * sample ids.
    met = docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id")).where(F.col(text_col).isNotNull())
    rows = cut(met.groupBy("_id", "_y").agg(F.min(F.struct(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))).alias("_r")).select("_id", "_y", "_r.*"))
    if rows.select("_y").distinct().count() < 2:
        return None

    def trained(held: pd.DataFrame) -> Model:
        held = held.sort_values("_id")
        held = held.iloc[np.argsort(pd.util.hash_array(held["_id"].to_numpy()), kind="stable")]
        return train(held["_text"].tolist(), held["_y"].to_numpy(), [x if isinstance(x, str) else None for x in held["_lang"]])

    return made_in_a_task(rows, trained)


def score_toxicity(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from CUT on); columns of these names are replaced.

    Whole texts are scored where they are read, without a shuffle. Null and empty texts are scored
    as having no words. Without a model every score is 0.
    """
    kept = small_batches(docs).drop("score", "predicted")
    if model is None:
        return kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: see BITS

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        own.table = own.table.astype(np.float32)
        for batch in batches:
            texts = ["" if x is None else x for x in batch.tolist()]
            yield pd.Series(np.concatenate([own.scores(texts[a:b]) for a, b in in_chunks(texts, 1 << 20)]) if texts else np.zeros(0))

    # So declared, it is not run once more for a filter on its result.
    out = kept.withColumn("score", F.pandas_udf(scored, "double").asNondeterministic()(F.coalesce(text_col, F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
