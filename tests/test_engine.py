"""Operators on hand-made rows."""

import hashlib
import json
import random
import unicodedata
import urllib.error

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.fixed import METRICS
from palimpsest.functions import text as X
from palimpsest.operators import canonical, claims, digests, judging, ledger, metrics, pairing, rendering, resample, scoring, validate
from palimpsest.plans import registry, tables
from palimpsest.sources import files, paged, sinks
from palimpsest.streaming import runner


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [('  "Lima"  ', "lima"), ("New   York!", "new york"), ("New\tYork!", "new york"), ("   ", ""), (None, None)])
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want


def reference_normal(x):
    x = " ".join(unicodedata.normalize("NFKC", x).lower().split())
    return x.strip(".,;:!?").strip("\"'")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF), max_size=12), min_size=20, max_size=40))
def test_normalize_exact(spark, texts):
    texts = [x for x in texts if "\x00" not in x and "İ" not in x]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    got = {r["i"]: r["n"] for r in X.normalize_exact(df, "x", "n").collect()}
    for i, x in enumerate(texts):
        assert got[i].strip() == reference_normal(x).strip(), repr(x)


def test_tokens_slug_dates_ids(spark):
    assert one(spark, "New\tYork", lambda c: X.token_count(X.normalize(c))) == 2
    assert one(spark, "   ", lambda c: X.token_count(X.normalize(c))) == 0
    assert one(spark, "Qwen2.5-14B-Instruct", X.slugify) == "qwen2-5-14b-instruct"
    for precision, want in ((11, "1952-04-11"), (10, "1952-04"), (9, "1952"), (8, None)):
        assert one(spark, "+1952-04-11T00:00:00Z", lambda c, p=precision: X.variable_date(c, F.lit(p))) == want
    assert one(spark, "http://www.wikidata.org/entity/Q42", X.entity_id) == "Q42"
    assert one(spark, "http://example.org/Q42", X.entity_id) is None
    with pytest.raises(Exception, match="not an entity url"):
        one(spark, "http://example.org/Q42", lambda c: X.entity_id(c, error=True))


def test_split_is_sha1_modulo_20(spark):
    ids = [f"Q{i}:P36" for i in range(500)]
    got = spark.createDataFrame([(x,) for x in ids], "x string").select("x", X.split_bucket(F.col("x")), X.split_of(X.split_bucket(F.col("x")))).collect()
    for x, bucket, split in got:
        assert bucket == int(hashlib.sha1(x.encode()).hexdigest(), 16) % 20
        assert split == ("train" if bucket <= 13 else "dev" if bucket <= 16 else "test")


RELATIONS = [("P36", "capital", "location", "What is the capital of {SUBJECT}?")]


def test_canonical_qa(spark):
    raw = spark.createDataFrame(
        [("Q1", "Austria", "P36", "Q10", "Vienna", "a"), ("Q2", "Peru", "P36", "Q20", " Lima ", "b"), ("Q3", "Atlantis", "P36", "Q30", "A", "c"), ("Q3", "Atlantis", "P36", "Q31", "B", "d"), ("Q4", "France", "P36", "Q40", "Paris", "e"), ("Q4", "France", "P99", "Q41", "x", "f")],
        "subject_id string, subject_text string, relation_id string, object_id string, object_text string, source_ref string",
    )
    relations = spark.createDataFrame(RELATIONS, "relation_id string, relation_name string, coarse_type string, question_template string")
    reasons = canonical.qa_reasons(raw, relations)
    assert {r[0]: r[1] for r in canonical.skip_counts(reasons).collect()} == {"multi_gold_object": 2, "relation_not_whitelisted": 1}
    items = {r["qa_id"]: r for r in canonical.qa_items(reasons).collect()}
    assert len(items) == 3
    assert items["Q1:P36"]["question"] == "What is the capital of Austria?"
    assert items["Q2:P36"]["answer_norm"] == "lima"


def items_of(spark, rows):
    return spark.createDataFrame([(q, "P36", "location", s, i, a.lower(), a) for q, s, i, a in rows], "qa_id string, relation_id string, coarse_type string, split string, answer_id string, answer_norm string, answer_text string")


def test_donors(spark):
    got = pairing.chosen_donors(items_of(spark, [("a", "train", "Q1", "Vienna"), ("b", "train", "Q2", "Milan"), ("c", "train", "Q3", "Paris")]))
    assert {r["qa_id"]: r["donor_answer_text"] for r in got.collect()}["a"] == "Milan"
    # Equal texts: the least id as a string.
    got = pairing.chosen_donors(items_of(spark, [("a", "train", "Q1", "Vienna"), ("b", "train", "Q900", "Paris"), ("c", "train", "Q100", "Paris")]))
    assert {r["qa_id"]: r["donor_qa_id"] for r in got.collect()}["a"] == "c"
    # The ratio looks one way: Vienna for Lima is 1.5, Lima for Vienna too little.
    items = items_of(spark, [("Q1:P36", "train", "Q1", "Vienna"), ("Q419:P36", "train", "Q2", "Lima"), ("Q142:P36", "test", "Q3", "Paris")])
    assert [(r["qa_id"], r["donor_answer_text"]) for r in pairing.chosen_donors(items).collect()] == [("Q419:P36", "Vienna")]
    counts = {r[0]: r[1] for r in pairing.failure_counts(items).collect()}
    assert counts["char_length_ratio_in_range"] >= 1
    # Named anchors have the pairs that they have among all.
    named = spark.createDataFrame([("Q1:P36",)], "qa_id string")
    shown = lambda p: sorted(map(tuple, p.where("qa_id = 'Q1:P36'").select("qa_id", "d_qa_id", *pairing.CHECKS).collect()))
    assert shown(pairing.pairs(items, named)) == shown(pairing.pairs(items)) != [] and pairing.pairs(items, named).where("qa_id <> 'Q1:P36'").count() == 0


def test_donor_null_ids_and_aliases(spark):
    rows = [("a", "P36", "location", "train", None, "vienna", "Vienna", ["vienna", "milano"]), ("b", "P36", "location", "train", None, "milano", "Milano", ["milano"]), ("c", "P36", "location", "train", "Q3", "verona", "Verona", ["verona"])]
    items = spark.createDataFrame(rows, "qa_id string, relation_id string, coarse_type string, split string, answer_id string, answer_norm string, answer_text string, answer_aliases_norm array<string>")
    got = {r["qa_id"]: r["donor_qa_id"] for r in pairing.chosen_donors(items).collect()}
    assert got == {"a": "c", "b": "c", "c": "b"}


FACTS = "entity_id string, entity_name string, slot string, value_id string, value_text string, value_norm string, source_ref string"


def facts_of(spark, rows):
    return spark.createDataFrame([(e, n, s, v, v, v.lower(), "x") for e, n, s, v in rows], FACTS)


def test_rubric_families(spark):
    ada = [("Q1", "Ada", "occupation", "mathematician"), ("Q1", "Ada", "award", "Medal B"), ("Q1", "Ada", "award", "Medal A"), ("Q1", "Ada", "field", "x1"), ("Q1", "Ada", "field", "x2"), ("Q2", "Bob", "occupation", "poet"), ("Q2", "Bob", "field", "art")]
    long = [("Q3", "Cy", "occupation", "poet"), ("Q3", "Cy", "field", "art"), ("Q3", "Cy", "field", "one two three four five six"), ("Q4", "Di", "field", "art")]
    got = {r["entity_id"]: r for r in pairing.rubric_outcomes(facts_of(spark, ada + long)).collect()}
    assert got["Q1"]["skip_reason"] is None and got["Q1"]["slot"] == "award"
    assert got["Q1"]["c1_text"] == "Ada was a mathematician. Ada received Medal A."
    assert {e: got[e]["skip_reason"] for e in ("Q2", "Q3", "Q4")} == {"Q2": "no_distinguishing_slot", "Q3": "candidate_length_ratio_exceeded", "Q4": "no_shared_occupation"}


def test_freeze(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train"), ("d", "dev"), ("e", "dev"), ("f", "test")], "family_id string, split string")
    frozen = pairing.freeze(df, {"train": 2, "dev": 1, "test": 1})
    assert sorted(r["family_id"] for r in frozen.where("selected").collect()) == ["a", "b", "d", "f"]
    stats = sinks.write_frozen(frozen, str(tmp_path / "x"), {"train": 2, "dev": 1, "test": 1})
    assert all(s["selected"] + s["discarded"] == s["available"] for s in stats.values())
    assert {r["reason"] for r in spark.read.parquet(str(tmp_path / "x/discarded")).collect()} == {"split_quota_exceeded"}
    with pytest.raises(ValueError, match="below their target"):
        sinks.write_frozen(frozen, str(tmp_path / "y"), {"train": 9})


def families(spark, flags):
    rows = [(i, b, p, c, b * p * c, 0, 4, 0) for i, (b, p, c) in enumerate(flags)]
    return spark.createDataFrame(rows, "family_id long, base_correct int, paraphrase_all_correct int, counterfactual_correct int, gcf_success int, tie_count int, variant_count int, order_disagreement_count int")


def test_summary(spark):
    m = metrics.summary(families(spark, [(1, 1, 1), (1, 1, 0), (0, 1, 1)])).first()
    assert m["base_acc"] == pytest.approx(2 / 3) and m["gcf"] == pytest.approx(1 / 3)
    assert (m["sensitivity_at_base_correct"], m["invariance_at_base_correct"], m["underreaction_at_base_correct"], m["overreaction_at_base_correct"]) == (0.5, 1.0, 0.5, 0.0)
    none = metrics.summary(families(spark, [(0, 1, 1)])).first()
    assert none["sensitivity_at_base_correct"] is None and none["gap"] == 0.0
    assert metrics.summary(families(spark, [(1, 1, 1)]).where("false")).count() == 0


SCORES = "family_id long, variant_id string, gold_winner_cid string, scores_ab_c1 double, scores_ab_c2 double, scores_ba_c1 double, scores_ba_c2 double"


def test_scores(spark):
    rows = [(1, "base", "c1", -0.30, -1.10, -0.40, -0.90), (1, "para_1", "c1", -0.70, -0.20, -0.20, -0.70), (1, "para_2", "c1", 0.0, 4e-7, 0.0, 4e-7), (1, "counterfactual", "c2", -1.0, -0.1, -1.0, -0.1)]
    v = {r["variant_id"]: r for r in judging.variant_results(spark.createDataFrame(rows, SCORES)).collect()}
    assert (v["base"]["scores_agg_c1"], v["base"]["scores_agg_c2"]) == (pytest.approx(-0.35), pytest.approx(-1.0))
    assert v["base"]["pred_winner_cid"] == "c1" and v["para_1"]["pred_winner_cid"] == "tie" and v["para_1"]["order_disagree"] == 1
    assert v["para_2"]["pred_tie"] == 1
    f = judging.family_results(judging.variant_results(spark.createDataFrame(rows, SCORES))).first()
    assert (f["base_correct"], f["paraphrase_all_correct"], f["counterfactual_correct"], f["gcf_success"], f["tie_count"]) == (1, 0, 1, 0, 2)
    with pytest.raises(Exception, match="four variants"):
        judging.family_results(judging.variant_results(spark.createDataFrame(rows[:3], SCORES))).collect()


def test_gcf_at_most_base(spark):
    rng = random.Random(3)
    f = families(spark, [tuple(rng.randint(0, 1) for _ in range(3)) for _ in range(50)])
    assert f.where("gcf_success > base_correct").count() == 0


def test_bootstrap_exact(spark):
    flags = [(1, 1, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0, 0, 1)]
    f = families(spark, flags)
    got = {r["metric"]: (r["point_estimate"], r["ci_lower"], r["ci_upper"]) for r in resample.bootstrap(f, resample.exact_draws(f, 200, 2026), []).collect()}
    rng, values = random.Random(2026), {"gap": [], "sensitivity_at_base_correct": []}
    for _ in range(200):
        s = [flags[rng.randrange(5)] for _ in range(5)]
        base = sum(b for b, _, _ in s)
        values["gap"].append(base / 5 - sum(b * p * c for b, p, c in s) / 5)
        if base:
            values["sensitivity_at_base_correct"].append(sum(b * c for b, _, c in s) / base)
    for m, v in values.items():
        v.sort()
        assert got[m][1:] == (pytest.approx(v[max(0, int(0.025 * len(v)) - 1)]), pytest.approx(v[min(len(v) - 1, int(0.975 * len(v)))]))


def test_bootstrap_draws_are_the_standard_librarys(spark):
    """Replicates of many sizes, from states found by skimming the stream."""
    for n in (1, 2, 541, 1024, 70_001):
        f = spark.range(n)
        got = {(r["rep"], r["ordinal"]): r["n"] for r in resample.exact_draws(f, 3, 11).groupBy("rep", "ordinal").agg(F.sum("times").alias("n")).collect()}
        rng, want = random.Random(11), {}
        for rep in range(3):
            for _ in range(n):
                key = (rep, rng.randrange(n))
                want[key] = want.get(key, 0) + 1
        assert got == want
    assert resample.exact_draws(spark.range(0), 3, 11).count() == 0


def test_jumps_are_steps():
    from palimpsest.operators import twister

    key = twister.seeded(5)
    for steps in (0, 1, 623, 624, 19937, 300_001):
        there = twister.source(key)
        there.random_raw(steps) if steps else None
        assert (twister.source(twister.jumped(key, steps)).random_raw(700) == there.random_raw(700)).all()
    assert twister.power(3 * 40_001) == twister._reduced(twister.power(3 * 40_001))


def test_draws_of_many_blocks(spark):
    """Replicates that begin within blocks, and blocks that a replicate fills."""
    n, reps, rng = 300_007, 4, random.Random(11)
    want = [np.unique([rng.randrange(n) for _ in range(n)], return_counts=True) for _ in range(reps)]
    got = resample.exact_draws(spark.range(n), reps, 11, words=1 << 17).groupBy("rep", "ordinal").agg(F.sum("times").alias("times")).toPandas().sort_values(["rep", "ordinal"])
    for rep, (ordinal, times) in enumerate(want):
        own = got[got["rep"] == rep]
        assert (own["ordinal"].to_numpy() == ordinal).all() and (own["times"].to_numpy() == times).all()
    assert resample.exact_draws(spark.range(0), 3, 1).count() == 0
    assert resample.exact_draws(spark.range(1), 5, 1).count() == 5


def test_ordinals_of_many_rows(spark, tmp_path):
    """Every ordinal once and in order of the id, with slices and without, however often the plan runs."""
    ids = spark.range(400_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("family_id"), (F.col("id") % 3).alias("part"))
    ids.repartition(7).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    for by in ([], ["part"]):
        for _ in range(2):
            got = resample.ordinals(ids, by).toPandas().sort_values([*by, "family_id"])
            place = got.groupby(by)["ordinal"] if by else [(0, got["ordinal"])]
            assert all(x.tolist() == list(range(len(x))) for _, x in place)


def test_hash_draws_are_as_many_as_rows(spark):
    f = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(5005)], "family_id long, s string")
    got = {(r["s"], r["rep"]): (r["n"], r["low"], r["high"]) for r in resample.hash_draws(f, ["s"], 4).groupBy("s", "rep").agg(F.sum("times").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).collect()}
    assert {k: v[0] for k, v in got.items()} == {(s, r): n for s, n in (("a", 5), ("b", 5000)) for r in range(4)}
    assert all(0 <= v[1] and v[2] < v[0] for v in got.values())


def test_key_sets_are_compared_in_tasks_of_few_rows(spark, tmp_path, monkeypatch):
    """Nulls and repeated keys as in EXCEPT; the tasks grow with the rows."""
    sides = {"lineitem": [1, 1, 2, 5, None, None], "orders": [2, 3, 3, 4, None]}
    for name, keys in sides.items():
        spark.createDataFrame([(k,) for k in keys], f"{name[0]}_orderkey long").write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 1)
    query = registry.QUERIES["key_set_diff"]
    diff = query(spark, str(tmp_path))
    assert sorted(map(tuple, diff.collect())) == [("extra", 3), ("extra", 4), ("missing", 1), ("missing", 5)]
    assert diff.rdd.getNumPartitions() == 11
    spark.createDataFrame([(7,)], "o_orderkey long").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert ("missing", None) in map(tuple, query(spark, str(tmp_path)).collect())


def test_digests_are_those_of_the_standard_library():
    """Pairs of any number of digits, with the borders between them and between arrays."""
    for rep, first, last in ((0, 0, 1), (7, 3, 12), (42, 0, 20_003), (1999, 99_990, 110_010), (12345, 10**9 - 3, 10**9 + 3)):
        at = first
        for start, left, right in digests.drawn(rep, first, last):
            assert start == at
            for k, got in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                text = hashlib.md5(f"{rep}:{at + k}".encode()).hexdigest()
                assert got == (int(text[:15], 16), int(text[16:31], 16))
            at += len(left)
        assert at == last
    numbers = np.array([0, 1, 2**60 - 1, 2**60 - 2**30], np.uint64)
    assert digests.remainders(numbers, 2_999_999).tolist() == [x % 2_999_999 for x in numbers.tolist()]


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_bootstrap_by_kinds_has_no_row_per_draw(spark, monkeypatch, chunk):
    """Equal to a row per draw: odd and even slices, one of a single family, a null slice, nulls, slices of several chunks and parts."""
    monkeypatch.setattr(resample, "CHUNK", chunk)
    monkeypatch.setattr(resample, "HELD", 2)
    some = random.Random(3)
    flag = lambda: some.choice([0, 1, 1, None])
    rows = [(f"f{i:05d}", "a" if i < 501 else "b" if i < 800 else "c" if i == 800 else None, flag(), flag(), flag(), some.randint(0, 4), 4, some.randint(0, 4), flag()) for i in range(830)]
    f = spark.createDataFrame(rows, f"family_id string, s string, {', '.join(f'{c} long' for c in metrics.COUNTED)}")
    plain = lambda df: sorted(map(repr, (r.asDict().items() for r in df.select(sorted(df.columns)).collect())))
    want = [plain(resample.bootstrap(f, resample.hash_draws(f, by, 30), by)) for by in ([], ["s"])]
    monkeypatch.setattr(resample, "hash_draws", None)
    assert [plain(resample.hash_bootstrap(f, by, 30)) for by in ([], ["s"])] == want
    assert resample.hash_bootstrap(f.where("false"), ["s"], 5).count() == 0
    want = plain(resample.bootstrap(f, resample.exact_draws(f, 10, 7), []))
    monkeypatch.setattr(resample, "exact_draws", None)
    monkeypatch.setattr(resample, "REP_BLOCKS", 2)
    assert plain(resample.exact_bootstrap(f, 10, 7, words=3000)) == want  # replicates cross blocks, blocks share runs
    assert resample.exact_bootstrap(f.where("false"), 5, 7).count() == 0


def brute_donors(rows):
    """Every anchor against every row of its pool, check by check; the choice, or the failures."""
    chosen, failed = {}, {}
    for a in rows:
        pool = [d for d in rows if d["pool"] == a["pool"]]
        date, best, counts = a["type"] == "date", [], {}
        for d in pool:
            n, k = len(d["norm"].split()), len(d["norm"])
            ok = {
                "different_subject_id": d["subject"] != a["subject"], "different_answer_id": None in (d["id"], a["id"]) or d["id"] != a["id"], "different_answer_norm": d["norm"] != a["norm"],
                "different_from_gold_aliases": d["norm"] not in a["aliases"], "forbidden_char_absent": not set(d["norm"]) & set(",;/|()"), "forbidden_and_absent": " and " not in d["norm"],
                "token_count_in_range": 1 <= n <= (4 if date else 6), "char_length_in_range": (4 <= k <= 20) if date else (2 <= k <= 40), "char_length_ratio_in_range": 0.67 <= k / len(a["norm"]) <= 1.5,
            }
            for c, fine in ok.items():
                counts[c] = counts.get(c, 0) + (not fine)
            if all(ok.values()):
                best.append((abs(n - len(a["norm"].split())), abs(k - len(a["norm"])), d["norm"], d["id"] or d["qa"], d["qa"]))
        if best:
            chosen[a["qa"]] = min(best)[-1]
        else:
            failed[a["qa"]] = (len(pool), counts)
    return chosen, failed


def test_donors_against_all_pairs(spark):
    """Frequent answers, aliases, missing ids, several rows of a subject, pools of few lengths: choice and failures row by row."""
    rng = random.Random(4)
    words = ["ab", "abc", "new york", "old town hall", "x, y", "bread and wine", "zzzz", "qrst", "a much longer answer than all of the others here"]
    words += [f"{a}{b}" for a in "klm" for b in ("aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii")]
    rows = []
    for i in range(260):
        norm = "kaa" if rng.random() < 0.4 else rng.choice(words)
        aliases = [norm, *rng.sample(words, rng.choice([0, 0, 2, 24]))]
        rows.append({"qa": f"q:{i:04d}", "subject": f"S{rng.randrange(120)}", "pool": (rng.choice(["P1", "P2"]), "date" if rng.random() < 0.3 else "place", rng.choice(["train", "dev"])),
                     "id": None if rng.random() < 0.2 else f"A{words.index(norm)}", "norm": norm, "aliases": aliases})
    for r in rows:
        r["type"] = r["pool"][1]
    df = spark.createDataFrame([(r["qa"], r["subject"], *r["pool"], r["id"], r["norm"], r["norm"].title(), r["aliases"]) for r in rows],
        "qa_id string, subject_id string, relation_id string, coarse_type string, split string, answer_id string, answer_norm string, answer_text string, answer_aliases_norm array<string>")
    chosen, failed = brute_donors(rows)
    got = {r["qa_id"]: r["donor_qa_id"] for r in pairing.chosen_donors(df).collect()}
    assert got == chosen and failed
    lone = {r["qa_id"]: (r["donor_pool_size"], {c: r[c] for c in pairing.CHECKS}) for r in pairing.invalid_anchors(df).collect()}
    assert lone == failed
    totals = {r["check_name"]: r["n"] for r in pairing.failure_counts(df).collect()}
    assert totals == {c: n for c in pairing.CHECKS if (n := sum(f[1][c] for f in failed.values()))}


def test_a_value_of_many_ids_needs_no_pool(spark, monkeypatch):
    """Most of a pool is one value under hundreds of ids, and one subject holds many values: equal to all pairs, ring by ring."""
    rng = random.Random(8)
    rows = []
    for i in range(700):
        norm = "kaa" if i < 500 else f"k{'abcdefghij'[rng.randrange(10)]}{'klmnop'[rng.randrange(6)]}"
        rows.append({"qa": f"q:{i:04d}", "subject": "S0" if i > 560 else f"S{i % 400}" if rng.random() < 0.9 else None, "pool": ("P1", "place", "train"), "type": "place", "id": f"A{i % 450}" if rng.random() < 0.9 else None, "norm": norm, "aliases": [norm]})
    df = spark.createDataFrame([(r["qa"], r["subject"], *r["pool"], r["id"], r["norm"], r["norm"].title(), r["aliases"]) for r in rows],
        "qa_id string, subject_id string, relation_id string, coarse_type string, split string, answer_id string, answer_norm string, answer_text string, answer_aliases_norm array<string>")
    want = brute_donors(rows)[0]
    for rings in ((8, 64, 512), (1, 2, 3)):  # few values a ring: anchors go outward to the end
        monkeypatch.setattr(pairing, "RINGS", rings)
        if rings[0] == 8:
            with monkeypatch.context() as m:
                m.setattr(pairing, "_of_whole_pool", None)
                assert {r["qa_id"]: r["donor_qa_id"] for r in pairing.chosen_donors(df).collect()} == want
        else:
            assert {r["qa_id"]: r["donor_qa_id"] for r in pairing.chosen_donors(df).collect()} == want
    held = pairing.donors_of(pairing.aliased(df)).groupBy("answer_norm").count()
    assert held.agg(F.max("count")).first()[0] <= 5


def test_samples(spark):
    df = spark.createDataFrame([(f"f{i:03d}",) for i in range(120)], "family_id string")
    want = sorted(random.Random(5).sample(sorted(f"f{i:03d}" for i in range(120)), 25))
    assert sorted(r[0] for r in resample.exact_sample(df, 25, 5, "family_id").collect()) == want
    assert resample.exact_sample(df.limit(3), 25, 5, "family_id").count() == 3
    assert resample.hash_sample(df, 25, 5, "family_id").count() == 25


def test_strict_decision(spark):
    cols = ", ".join(f"{m} double" for m in METRICS)
    mk = lambda gap: spark.createDataFrame([("keyed", 1.0, 1.0 - gap, gap, 0.9, 1.0, 0.0, 0.0)], f"task_family string, {cols}")
    ci = spark.createDataFrame([("keyed", 0.03, 0.09, 0.8, 0.99)], "task_family string, gap_ci_lower double, gap_ci_upper double, sens_ci_lower double, sens_ci_upper double")
    d = metrics.strict_delta(mk(0.08), mk(0.06), ci, ["task_family"], METRICS, F.col("task_family") == "rubric")
    assert metrics.decision(d).first()["status"] == "supported"
    with pytest.raises(Exception, match="same slices"):
        metrics.strict_delta(mk(0.08), mk(0.06).where("false"), ci, ["task_family"], METRICS, F.lit(False)).collect()


def test_stability_by_hand(spark):
    rows = [(1, 1, 1, 1, 1, 0, 4, 0), (2, 1, 1, 0, 0, 1, 4, 2)]
    f = spark.createDataFrame(rows, families(spark, [(1, 1, 1)]).schema)
    got = {r["subset"]: (r["gap"], r["n_families"], r["share_of_total_families"]) for r in metrics.by_stability(f).collect()}
    assert got == {"all_families": (0.5, 2, 1.0), "order_stable": (0.0, 1, 0.5), "order_unstable": (1.0, 1, 0.5), "order_stable_no_ties": (0.0, 1, 0.5)}


def test_contracts(spark):
    v = lambda i, k, s, g: Row(variant_id=i, kind=k, semantics_id=s, gold_winner_cid=g)
    good = [v("base", "base", "s", "c1"), v("para_1", "paraphrase", "s", "c1"), v("para_2", "paraphrase", "s", "c1"), v("counterfactual", "counterfactual", "t", "c2")]
    rows = [("ok", good), ("id", [*good[:3], v("other", "counterfactual", "t", "c2")]), ("flip", [*good[:3], v("counterfactual", "counterfactual", "t", "c1")])]
    schema = "name string, variants array<struct<variant_id:string,kind:string,semantics_id:string,gold_winner_cid:string>>"
    df = spark.createDataFrame(rows, schema).withColumn("split", F.lit("dev")).withColumn("candidates", F.array(F.struct(F.lit("c1").alias("cid")), F.struct(F.lit("c2").alias("cid"))))
    got = {r[0]: r[1] for r in df.select("name", validate.family()).collect()}
    assert got["ok"] == [] and "wrong_variants" in got["id"] and got["flip"] == ["counterfactual_not_flipped"]
    with pytest.raises(ValueError, match="contract"):
        validate.abort_on(df.withColumn("violations", validate.family()))


def test_claims(spark):
    c = lambda rank, **value: {"rank": rank, "mainsnak": {"snaktype": "value", "datavalue": {"value": value}}}
    payload = {"id": "Q5", "labels": {"en": {"value": "Ada"}}, "claims": {"P166": [c("normal", id="Q1"), c("preferred", id="Q2"), c("preferred", **{"numeric-id": 3}), c("deprecated", id="Q999")], "P569": [c("normal", time="+1952-04-11T00:00:00Z", precision=10)]}}
    df = spark.createDataFrame([(json.dumps(payload),)], "j string").select(F.from_json("j", claims.PAYLOAD).alias("p")).select("p.*")
    got = sorted((r["slot"], r["value_id"], r["value_text"]) for r in claims.rows(df, {"award": "P166", "born": "P569"}, ("born",)).collect())
    assert got == [("award", "Q2", None), ("award", "Q3", None), ("born", None, "1952-04")]
    facts = facts_of(spark, [("Q1", "A", "occupation", "x"), ("Q1", "A", "award", "m"), ("Q1", "A", "award", "n"), ("Q1", "A", "field", "f"), ("Q2", "B", "award", "m")])
    assert claims.eligible(facts).count() == 4


def test_ledger(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "f", "PENDING"), (2, "2024-01-01 00:00:01", "f", "INFLIGHT"), (3, "2024-01-01 00:00:01", "g", "COMPLETE")], "event_id long, ts string, family_id string, state string")
    e = e.withColumn("ts", F.to_timestamp("ts"))
    got = {r["family_id"]: (r["state"], r["retries"], r["stale_recovered"]) for r in ledger.recovery(e).collect()}
    assert got == {"f": ("PENDING", 1, 1), "g": ("COMPLETE", 0, 0)}
    assert tuple(ledger.progress(ledger.latest_state(e.where("false"))).first()) == (0, 0, 0, 0)
    assert [r[0] for r in ledger.pending(spark.createDataFrame([("f",), ("g",), ("h",)], "family_id string"), ledger.latest_state(e)).orderBy("family_id").collect()] == ["f", "h"]


def test_prompt_and_scoring(spark):
    text = spark.range(1).select(rendering.prefix("strict_criterion_emphasis", F.lit("t"), F.lit("c"), F.lit("a"), F.lit("b")).alias("p")).first()[0]
    assert "Final label:" in text and "Judge ONLY by the provided criterion." in text and text.endswith("ASSISTANT:\n")
    prompts = spark.createDataFrame([(1, "base", "c1", o, f"{o} text") for o in ("AB", "BA")], "family_id long, variant_id string, gold_winner_cid string, order_id string, prefix string")
    out = scoring.mirrored(scoring.score(prompts, lambda: lambda texts: [(-0.3, -1.1) if t.startswith("AB") else (-0.9, -0.4) for t in texts])).first()
    assert (out["scores_ab_c1"], out["scores_ab_c2"], out["scores_ba_c1"], out["scores_ba_c2"]) == (-0.3, -1.1, -0.4, -0.9)
    recorded = prompts.limit(1).select(F.sha2("prefix", 256).alias("prefix_sha256"), F.lit(-1.0).alias("score_a"), F.lit(-2.0).alias("score_b"))
    with pytest.raises(Exception, match="no recorded score"):
        scoring.replay(prompts, recorded).collect()


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    (tmp_path / "good.jsonl").write_text('{"a": "x", "b": 1}\n\n{"a": null, "b": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": "x"\n[1]\n')
    df = files.read_jsonl(spark, str(tmp_path / "good.jsonl"), schema)
    assert df.count() == 2
    with pytest.raises(files.SourceError, match="bad.jsonl"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema)
    sinks.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), schema).where("a IS NULL").count() == 1
    text = spark.createDataFrame([("two\nlines", 'a "quote"')], "p string, q string")
    sinks.write_csv(text, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), ["p", "q"]).collect() == text.collect()
    assert sinks.markdown(text.select("q")) == '| q |\n| --- |\n| a "quote" |\n'
    sinks.write_json({"b": 1}, tmp_path / "r" / "x.json")
    assert files.load_config(tmp_path / "r" / "x.json") == {"b": 1}
    assert files.reusable({"stage": "full", "page_size": 5}, {"stage": "full", "page_size": 5}) and not files.reusable({"stage": "pilot"}, {"stage": "full"})
    for run in ("r1", "r2"):
        sinks.write_json({"run_id": run}, tmp_path / "runs" / run / "summary_metrics.json")
        sinks.write_json({"seed": 1}, tmp_path / "runs" / run / "bootstrap_ci.json")
    got = files.read_summaries(spark, str(tmp_path / "runs"), T.StructType([T.StructField("run_id", T.StringType())]), T.StructType([T.StructField("seed", T.LongType())]))
    assert sorted((r["run_id"], r["seed"]) for r in got.collect()) == [("r1", 1), ("r2", 1)]


def test_retry():
    waits, codes = [], [429, 503, 200]

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return b'{"ok": 1}'

    def opener(url, timeout):
        assert timeout == 60
        code = codes.pop(0)
        if code == "late":
            raise TimeoutError
        if code != 200:
            raise urllib.error.HTTPError(url, code, "", {"Retry-After": "20"}, None)
        return Answer()

    assert paged.get_json("u", opener=opener, sleep=waits.append) == {"ok": 1}
    assert waits == [20, 2]
    codes[:] = ["late", 200]
    assert paged.get_json("u", opener=opener, sleep=waits.append) == {"ok": 1} and waits[-1] == 1
    codes[:] = ["late"] * 2
    with pytest.raises(TimeoutError):
        paged.get_json("u", tries=2, opener=opener, sleep=waits.append)
    codes[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        paged.get_json("u", opener=opener, sleep=waits.append)


def test_paged_source(spark, tmp_path):
    """Recorded pages: it goes on where an answer says, and stops at a short page, an empty one, or the last allowed."""

    def page(name, titles, follow=None):
        held = {"query": {"search": [{"title": t} for t in titles]}} | ({"continue": {"sroffset": follow}} if follow is not None else {})
        (tmp_path / f"{name}.json").write_text(json.dumps(held))

    page("a-0", ["Q3", "Q1"], 7)
    page("a-7", ["Q2", "Talk:x"], 9)
    page("a-9", ["Q3"])
    page("a-11", ["Q99"])
    page("b-0", ["Q5", "Q6"])
    page("b-2", [])
    page("c-0", ["Q7", "Q8"], 2)
    page("c-2", ["Q9", "Q10"], 4)
    page("c-4", ["Q11", "Q12"], 6)
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("url", f"file://{tmp_path}/{{query}}-{{offset}}.json").option("page_size", 2).option("rows", "query.search").option("next", "continue.sroffset")
    ids = lambda queries, pages: [r[0] for r in paged.entity_ids(read.option("queries", json.dumps(queries)).option("pages", pages).load()).collect()]
    assert ids(["a"], 5) == ["Q1", "Q2", "Q3"] and ids(["b"], 5) == ["Q5", "Q6"] and ids(["c"], 2) == ["Q10", "Q7", "Q8", "Q9"]
    assert ids(["a", "b"], 5) == ["Q1", "Q2", "Q3", "Q5", "Q6"]
    assert paged.PagedReader({"page_size": "500"}).size == 50 and len(paged.PagedReader({"ids": ",".join(f"Q{i % 60}" for i in range(200))}).partitions()) == 2
    with pytest.raises(ValueError, match="positive"):
        paged.PagedReader({"pages": "0"})


def test_entities_and_bindings(spark, tmp_path):
    held = {"entities": {"Q1": {"id": "Q1", "labels": {}}, "Q2": {"id": "Q2", "missing": ""}, "Q9": {"id": "Q9"}}}
    reader = paged.PagedReader({"url": "u/{ids}", "ids": "Q3,Q1,Q2,Q1", "rows": "entities"})
    reader.ask = lambda url: held if url == "u/Q1%7CQ2%7CQ3" else None
    assert [k for k, _ in reader.read(reader.partitions()[0])] == ["Q1"]
    v = lambda **b: json.dumps({k: {"value": x} for k, x in b.items()})
    e = "http://www.wikidata.org/entity/"
    rows = [v(subject=f"{e}Q1", subjectLabel=" Ada ", object=f"{e}Q7", objectLabel="London"), v(subject=f"{e}Q1", subjectLabel="Ada", object=f"{e}Q7", objectLabel="London"), v(subject=f"{e}Q2", object=f"{e}Q7", objectLabel="London"), v(subject=f"{e}Q3", subjectLabel="C", object="_:blank", objectLabel="x")]
    pages = spark.createDataFrame([("q", r) for r in rows], "query string, row string")
    got = [tuple(r) for r in paged.relation_rows(pages, "P19").select("subject_id", "subject_text", "object_id", "object_text", "source_ref").collect()]
    assert got == [("Q1", "Ada", "Q7", "London", "wikidata:Q1:P19:Q7")]
    assert paged.relation_rows(pages, "P19", labelled=False).count() == 2
    dates = spark.createDataFrame([("q", v(subject=f"{e}Q1", subjectLabel="Ada", time="+1815-12-10T00:00:00Z", precision="11")), ("q", v(subject=f"{e}Q2", subjectLabel="B", time="bad"))], "query string, row string")
    assert [(r["object_id"], r["object_text"]) for r in paged.relation_rows(dates, "P569", dates=True).collect()] == [(None, "1815-12-10")]
    assert paged.search_query("P19", "Q5") == "haswbstatement:P31=Q5 haswbstatement:P19"
    assert "wd:Q1 wd:Q2" in paged.slot_query("P166", ["Q2", "Q1", "Q2"]) and "{limit}" in paged.relation_query("P569", "Q5", True) and "{offset}" in paged.entity_query("Q5")


def test_control_and_heartbeat(spark, tmp_path):
    from palimpsest.streaming.control import Control, Heartbeat

    stop = Control(tmp_path / "STOP", stop_after=5)
    assert not stop()
    (tmp_path / "STOP").write_text("")
    assert stop()
    stop.paused()
    assert not stop() and not (tmp_path / "STOP").exists()
    stop.done = 5
    assert stop()
    stop = Control()
    stop.signalled()
    assert stop()
    stop.signalled()
    with pytest.raises(KeyboardInterrupt):
        stop()
    now = [100.0]
    h = Heartbeat(str(tmp_path / "beat.json"), {"run_id": "r"}, clock=lambda: now[0], pending=30)
    assert h.snapshot()["eta_seconds"] is None and not h.snapshot()["stalled"]
    now[0] = 110.0
    h.committed(10, 80, "f9")
    now[0] = 120.0
    h.committed(10, 40, "f19")
    s = json.loads((tmp_path / "beat.json").read_text())
    assert (s["run_id"], s["completed_families"], s["pending_families"], s["last_completed_family_id"]) == ("r", 20, 10, "f19")
    assert s["prompt_instances_per_sec_ewma"] == pytest.approx(0.8 * 8 + 0.2 * 4) and s["families_per_hour_ewma"] == pytest.approx(3600) and s["eta_seconds"] == 10
    now[0] = 239.0
    assert not h.snapshot()["stalled"]
    now[0] = 241.0
    assert h.snapshot()["stalled"]


def test_runner_with_control(spark, tmp_path):
    from pyspark.sql import types as T

    from palimpsest.streaming.control import Control

    schema = T.StructType([T.StructField("family_id", T.StringType())])
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(json.dumps({"family_id": f"f{i}{k}"}) for k in range(2)))
    told, rows = [], F.array(*[F.struct(F.lit(v).alias("variant_id"), F.lit(o).alias("order_id")) for v, o in (("para_1", "BA"), ("base", "BA"), ("base", "AB"))])
    judge = lambda df: df.withColumn("ok", F.lit(1)).withColumn("variants", rows).withColumn("prompts", rows)
    args = (spark, str(tmp_path / "in"), schema, judge, str(tmp_path / "ledger"))
    stop = Control(tmp_path / "STOP", stop_after=4)
    assert runner.run(*args, stop=stop, progress=lambda k, n: told.append((k, n))) == "PAUSED" and told == [(0, 2), (1, 2)]
    assert runner.run(*args, stop=Control(tmp_path / "STOP")) == "COMPLETED"
    ledger_ = str(tmp_path / "ledger")
    assert [tuple(r) for r in runner.scan(spark, ledger_).collect()] == [(f"f{i}{k}", 1) for i in range(3) for k in range(2)]
    assert [tuple(r) for r in runner.scan(spark, ledger_, "prompt").limit(3).collect()] == [("f00", "base", "AB"), ("f00", "base", "BA"), ("f00", "para_1", "BA")]
    assert runner.scan(spark, ledger_, "variant").count() == 18
    (tmp_path / "in" / "9.jsonl").write_text(json.dumps({"family_id": "f9"}))
    twice = Control()
    twice.signalled()
    twice.signalled()
    with pytest.raises(KeyboardInterrupt):
        runner.run(*args, stop=twice)


def test_freeze_of_ids_with_one_beginning(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("biorubric_"), F.sha1(F.col("id").cast("string").cast("binary"))).alias("family_id"), F.when(F.col("id") % 3 == 0, "dev").otherwise("train").alias("split"))
    frozen = pairing.freeze(df, {"train": 1000, "dev": 100})
    got = [r[0] for r in frozen.where("selected AND split = 'dev'").orderBy("place").select("family_id").collect()]
    assert got == sorted(r[0] for r in df.where("split = 'dev'").select("family_id").collect())[:100]
    sinks.write_frozen(frozen, str(tmp_path / "x"), {"train": 1000, "dev": 100}, invalid=spark.createDataFrame([("a", "no")], "family_id string, skip_reason string"), qc={"task_family": "biorubric"})
    assert spark.read.json(str(tmp_path / "x/combined")).count() == spark.read.json(str(tmp_path / "x/split_manifest")).count() == 1100
    assert spark.read.json(str(tmp_path / "x/invalid")).count() == 1
    qc = json.loads((tmp_path / "x/qc.json").read_text())
    assert qc["task_family"] == "biorubric" and qc["splits"]["dev"]["selected"] == 100


def test_notes_and_bundles(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.1, 0.06, -0.04, 0.9, 0.95, True), ("b", None, 0.0, None, None, 1.0, False)], "task_family string, gap_standard double, gap_strict double, gap_delta double, sensitivity_at_base_correct_standard double, sensitivity_at_base_correct_strict double, gate_passed boolean")
    decision = spark.createDataFrame([("supported", 1, 1, 1)], "status string, supported_slice_count long, helped_slice_count long, residual_slice_count long")
    note = sinks.decision_note(d, decision)
    assert "- Status: `supported`" in note and "- a: gap 0.100000 -> 0.060000 (delta -0.040000); sensitivity 0.900000 -> 0.950000; gate passed: True" in note and "- b: gap n/a" in note
    stability = spark.createDataFrame([("s1", "all_families", 0.5, 4), ("s1", "order_stable", 0.25, 2), ("s2", "order_stable", 0.0, 1)], "slice_label string, subset string, gap double, n_families long")
    rates = spark.createDataFrame([(f"s{i}", "base", i / 10, 0.0, 0.1) for i in range(9)], "slice_label string, variant_id string, order_disagreement_rate double, pred_tie_rate double, variant_error_rate double")
    preference = spark.createDataFrame([("s1", 0.125, 0.0, -0.5), ("s2", -0.25, 0.0, 0.0)], "slice_label string, position_bias_second_minus_first double, tie_rate double, underlying_bias_c2_minus_c1 double")
    note = sinks.diagnostics_note(stability, rates, preference)
    assert "- s1: all families gap 0.500; order-stable gap 0.250 over n=2\n" in note and "- s2: all" not in note
    assert note.count("order disagreement 0.") == 6 and note.index("s8 / base") < note.index("s3 / base") and "s2 / base" not in note
    assert note.index("second minus first +0.125") < note.index("second minus first -0.250")
    f = families(spark, [(1, 1, 1), (1, 0, 1)])
    boot = resample.bootstrap(f, resample.exact_draws(f, 20, 1), [])
    sinks.write_bundle(str(tmp_path / "b"), summary=metrics.summary(f), bootstrap=boot, families=f, variants=f, identity={"seed": 1})
    held = json.loads((tmp_path / "b/bootstrap_ci.json").read_text())
    assert held["seed"] == 1 and held["metrics"]["gap"]["point_estimate"] == 0.5 and json.loads((tmp_path / "b/summary_metrics.json").read_text())["n_families"] == 2
    assert sinks.sidecar_paths("d/qa.parquet") == {"qc_report_path": "d/qa_qc.json", "split_manifest_path": "d/qa_splits.jsonl"} and sinks.sidecar_paths("x")["qc_report_path"] == "x_qc.json"
    asked = {"stage": "full", "page_size": 50, "max_pages": 2}
    assert sinks.write_source_artifacts(f, str(tmp_path / "src"), asked)["row_count"] == 2
    assert files.reusable(json.loads((tmp_path / "src/summary.json").read_text()), asked)


def test_models_by_name(spark):
    rows = [(1, v, "c1" if v != "counterfactual" else "c2", o, f"{v} {o}", m) for v in ("base", "para_1", "para_2", "counterfactual") for o in ("AB", "BA") for m in ("m1", "m2")]
    prompts = spark.createDataFrame(rows, "family_id long, variant_id string, gold_winner_cid string, order_id string, prefix string, model_id string")
    right = lambda: lambda texts: [(-0.1, -1.0) if (t.endswith("AB")) != t.startswith("counter") else (-1.0, -0.1) for t in texts]
    wrong = lambda: lambda texts: [(-1.0, -0.1)] * len(texts)
    got = {(r["model_id"], r["prefix"]): r["score_a"] for r in scoring.score_by_model(prompts, {"m1": right, "m2": wrong}).collect()}
    assert got["m1", "base AB"] == -0.1 and got["m2", "base AB"] == -1.0 and len(got) == 16
    with pytest.raises(Exception, match="no loader"):
        scoring.score_by_model(prompts, {"m1": right}).collect()
    variants, held = scoring.evaluate(prompts.where("model_id = 'm1'"), right)
    assert variants.count() == 4 and held.first()["gcf_success"] == 1


def test_runner_pauses_and_resumes(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("family_id", T.StringType()), T.StructField("x", T.LongType())])
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"family_id": f"f{i}", "x": i}))
    calls = []

    def stop():
        calls.append(1)
        return len(calls) == 2

    args = (spark, str(tmp_path / "in"), schema, lambda df: df.withColumn("y", F.col("x") * 2), str(tmp_path / "ledger"))
    assert runner.run(*args, stop=stop) == "PAUSED"
    assert runner.results(spark, str(tmp_path / "ledger")).count() == 1
    assert runner.run(*args) == "COMPLETED"
    assert sorted((r["family_id"], r["y"]) for r in runner.results(spark, str(tmp_path / "ledger")).collect()) == [("f0", 0), ("f1", 2)]
    assert runner.run(*args) == "COMPLETED" and runner.results(spark, str(tmp_path / "ledger")).count() == 2


def test_run_identity(spark):
    from palimpsest.fixed import RELATIONS
    from palimpsest.operators import runs

    stem = runs.run_stem("qa_key", "Qwen2.5-14B-Instruct", "strict criterion-emphasis", "test")
    assert stem == "qa-key__qwen2-5-14b-instruct__strict-criterion-emphasis__test"
    good = {k: {"relation_name": v[0], "coarse_type": v[1], "extra": 1} for k, v in RELATIONS.items()}
    runs.check_relations(good)
    with pytest.raises(runs.RunError, match="P36"):
        runs.check_relations(good | {"P36": {"relation_name": "capital", "coarse_type": "date"}})
    with pytest.raises(runs.RunError):
        runs.check_slots(["occupation"])
    with pytest.raises(runs.RunError):
        runs.check_targets({"train": 1, "dev": 0, "test": 1})
    f = spark.createDataFrame([(i, f"f{i}") for i in range(50)], "ordinal long, family_id string")
    spec = runs.Slice("r", "qa_key", "m", "standard", "test", "a", "b")
    saved = runs.manifest(spec, f)
    runs.check_resume(saved, spec, f.repartition(3))
    with pytest.raises(runs.RunError, match="queue"):
        runs.check_resume(saved, spec, f.limit(49))
    with pytest.raises(runs.RunError, match="queue"):  # the same ids in another order
        runs.check_resume(saved, spec, f.withColumn("ordinal", 49 - F.col("ordinal")))
    with pytest.raises(runs.RunError, match="prompt_version"):
        runs.check_resume(saved, runs.Slice("r", "qa_key", "m", "standard", "test", "a", "b", prompt_version="2"), f)
    runs.check_resume(saved, runs.Slice("r", "qa_key", "m", "standard", "test", "a", "b", code_version="other"), f)
    assert runs.queue_digest(f.where("false"))["n"] == 0
    assert runs.dataset_path("qa_key", "dev").endswith("qakey/dev_families.jsonl") and len(runs.attempt_id().split("__")) == 4
    assert runs.code_version("/") == "not_a_git_repo"
    one = runs.status(saved | {"state": "PAUSED"}, {"complete": 3}, "l")
    assert one["total_families"] == 50 and runs.matrix_status([one, {"state": None}]) == {"n_slices": 2, "states": {"MISSING": 1, "PAUSED": 1}, "total_families": 50, "completed_families": 3}
    assert runs.utc_now().endswith("Z")
