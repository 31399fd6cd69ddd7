"""Resampling, license scans and hard negatives against brute force; nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives, importance, licenses
from palimpsest.llm.words import terms

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word and more, " * 120_000  # over a megabyte: read in more than one part
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PLAIN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09 .,\x00\x7féß日\n", max_size=60), st.integers(1, 20))
def test_words_in_parts_are_all_words(text, most):
    assert [w.decode() for part in terms(text, most) for w in part] == words(text)
    assert list(terms(None)) == []


# 11 importance resampling


def brute_weights(docs, target, widest, n_buckets, percent, least_words, seed):
    def grams(text):
        w = words(text)
        return Counter(" ".join(w[i : i + k]) for k in range(1, widest + 1) for i in range(len(w) - k + 1))

    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    counts = [Counter(), Counter()]
    for side, texts in enumerate(([t for _, t in docs], target)):
        for text in texts:
            for f, c in grams(text).items():
                counts[side][bucket(f)] += c
    s, t = (c.total() for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1) * (s + n_buckets) / ((counts[0][b] + 1) * (t + n_buckets))))
    rows = []
    for key, text in docs:
        own = grams(text)
        weight = sum(c * gain(bucket(f)) for f, c in own.items())
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words(text)), own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return rows, [(r[0], r[4]) for r in drawn]


def test_weights_are_those_of_counting(spark):
    some = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "X9"]
    docs = [(i, " ".join(some.choices(vocabulary, k=some.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, docs[3][1]), (None, None), (202, LONG), (7, docs[7][1]), (7, docs[7][1]), (8, docs[9][1])]
    target = [" ".join(some.choices(vocabulary[:10], k=30)) for _ in range(20)] + [None, ""]
    left = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, rank string, weight long").repartition(5)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    for widest, frequent in ((1, 1 << 17), (1, 5), (3, 0), (3, 1000)):
        got = importance.weigh(left, right, widest=widest, n_buckets=97, percent=30, least_words=4, frequent=frequent).collect()
        rows, drawn = brute_weights(docs, target, widest, 97, 30, 4, 2024)
        assert sorted((repr(r["doc_id"]), r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted((repr(r[0]), *r[1:]) for r in rows)
        ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
        assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn
    kept = importance.resample(left, right, n_buckets=97, percent=30, least_words=4)
    assert kept.columns == left.columns and set(r["rank"] for r in kept.collect()) == {"clash"}
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(k) for k, _ in brute_weights(docs, target, 1, 97, 30, 4, 2024)[1])


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    one = spark.createDataFrame([(1, "a b", None, None, 1)], DOCS)
    assert importance.weigh(none, one).count() == 0 and importance.resample(none, none).count() == 0
    row = importance.weigh(one, none.select("text"), least_words=1, percent=100).first()
    assert (row["n_features"], row["rank"]) == (2, 1)


# 12 license scans


def brute_scan(text, templates, phrases, least):
    w = words(text)
    base = [(label, i) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    blocks = []
    for k, (_, template) in enumerate(templates):
        own = set(words(template))
        step = max(8, 2 ** math.ceil(math.log2(len(words(template)))))
        for start in range(0, len(w), step):
            both = len(own & set(w[start : start + 2 * step]))
            if 100 * both >= least * len(own):
                blocks.append((k, start, min(2 * step, len(w) - start), both))
    return base, sorted(blocks)


def test_blocks_are_those_of_trying_all(spark):
    some = random.Random(5)
    noise = ["lorem", "the", "of", "license", "under", "4", "and", "public"]
    texts = [None, "", "All rights reserved all RIGHTS, reserved. rights", "CC-BY", "cc", LONG]
    for _ in range(120):
        parts = []
        for _ in range(some.randint(1, 4)):
            parts += some.choices(noise, k=some.randint(0, 40))
            own = licenses.TEMPLATES[some.randrange(len(licenses.TEMPLATES))][1].split()
            parts += [w for w in own if some.random() > some.choice([0, 0, 0.05, 0.2])]
        texts.append(" ".join(parts))
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, labels string").repartition(4)
    for least in (90, 60):
        for r in licenses.scan(rows, least=least).collect():
            base, blocks = brute_scan(texts[r["doc_id"]], licenses.TEMPLATES, licenses.PHRASES, least)
            assert [(b["template"], b["start"], b["length"], b["overlap"]) for b in r["blocks"]] == blocks
            assert (r["n_words"], r["n_base"]) == (len(words(texts[r["doc_id"]])), len(base))
            assert (r["first_word"], r["last_word"]) == ((min(i for _, i in base), max(i for _, i in base)) if base else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for x, _ in base}))
            assert r["labels"] == ",".join(sorted({x for x, _ in base} | {licenses.TEMPLATES[k][0] for k, *_ in blocks}))
            sizes = [len(set(words(t))) for _, t in licenses.TEMPLATES]
            assert r["score"] == (1.0 if base else max((b[3] / sizes[b[0]] for b in blocks), default=0.0))
    assert rows.columns[:2] == licenses.scan(rows).columns[:2] and licenses.scan(rows).columns.count("labels") == 1
    assert licenses.scan(rows.where("false")).count() == 0
    assert licenses.scan(rows.union(rows)).count() == 2 * len(texts)


def test_whole_templates_are_found_wherever_they_stand(spark):
    rows = [(k, pad, " ".join(["pad"] * pad) + " " + t + " end" * pad) for k, (_, t) in enumerate(licenses.TEMPLATES) for pad in (0, 7, 50, 133)]
    for r in licenses.scan(spark.createDataFrame(rows, "k int, pad int, text string")).collect():
        assert any(b["template"] == r["k"] for b in r["blocks"])
    own = [("none", "..."), ("mine", "one two three")]
    row = licenses.scan(spark.createDataFrame([("x one y two, THREE",)], "text string"), templates=own, phrases=[("y two", "p")]).first()
    assert (row["labels"], row["first_word"], [b["label"] for b in row["blocks"]]) == ("mine,p", 2, ["mine"])


# 13 hard negatives


def brute_negatives(rows, k, n_positives, lower, upper, scale):
    one = {}
    for key, vec, label in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        one.setdefault(key, (label, [math.floor(scale * x) for x in vec]))
    out = []
    for a, (label, v) in one.items():
        if a % 100:
            continue
        order = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), key, other) for key, (other, u) in one.items() if key != a and len(u) == len(v))
        for s, p, _ in [x for x in order if x[2] == label][:n_positives]:
            fit = [x for x in order if x[2] != label and lower * -s <= 100 * -x[0] <= upper * -s][:k]
            out += [(a, p, i + 1, key, -s, -t) for i, (t, key, _) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    some = np.random.default_rng(1)
    rows = [(int(i) * 20, [float(np.float32(x)) for x in some.integers(-2, 9, 6) / 4], int(some.integers(0, 3))) for i in range(160)]
    rows += [(400, None, 1), (500, [1.0] * 6, None), (None, [1.0] * 6, 1), (600, [float("nan")] * 6, 1), (700, [None] + [1.0] * 5, 1), (800, [float("inf")] + [1.0] * 5, 1)]
    rows += [rows[5], (rows[10][0], [0.5] * 6, 2), (10_000, [1.0, 2.0], 1), (10_001, [1.0, 1.0], 1), (10_002, [0.5, 1.0], 0), (10_100, [], 1), (10_101, [], 0), (10_200, [1e12] * 6, 1), (10_300, [3e11] * 6, 1)]
    return [r for r in rows if r[0] is None or r[0] < 400 or r[0] > 800 or r[2] is None or r[1] is None or None in r[1] or not all(map(math.isfinite, r[1]))]


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_those_of_sorting_all(spark, monkeypatch, small):
    if small:  # several passes, blocks and tasks
        for name, value in (("ANCHOR_BYTES", 400), ("BLOCK_ROWS", 7), ("TASK_ROWS", (20, 40))):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).repartition(6)
    for k, n, lower, upper, scale in ((10, 5, 30, 90, 256), (3, 2, 50, 100, 4)):
        got = sorted(map(tuple, hard_negatives.hard_negatives(df, k=k, n_positives=n, lower=lower, upper=upper, scale=scale).collect()))
        assert got == brute_negatives([(a, None if v is None else [x if x is None else float(np.float32(x)) for x in v], b) for a, v, b in rows], k, n, lower, upper, scale)
    assert got and hard_negatives.hard_negatives(df.where("false")).count() == 0
    assert hard_negatives.hard_negatives(df, anchor=F.col("_id") < 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**15, 1.0], [2.0**40, 0.0]])
    assert hard_negatives.scores(a, b).tolist() == [[2**55 + 3, hard_negatives.LIMIT]]
