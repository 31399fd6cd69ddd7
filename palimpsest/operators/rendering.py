"""Prompt, candidate and rubric texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed import CANDIDATE_SENTENCES, KEY_WORDINGS, KINDS, RUBRIC_ITEMS, RUBRICS, SYSTEM_PROMPTS


def filled(template: str, **values: Column) -> Column:
    """A template with {NAMES} as one concatenation."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def question(template: Column, subject: Column) -> Column:
    return F.replace(template, F.lit("{SUBJECT}"), subject)


def prefix(prompt: str, task: Column, criterion: Column, a: Column, b: Column) -> Column:
    """P16 for models without a chat template: roles in capitals, blank lines between."""
    user = F.concat_ws("\n\n", F.concat(F.lit("Task:\n"), task), F.concat(F.lit("Criterion:\n"), criterion), F.concat(F.lit("Candidate A:\n"), a), F.concat(F.lit("Candidate B:\n"), b), F.lit("Which candidate better satisfies the criterion?\nFinal label:"))
    return F.concat_ws("\n\n", F.lit("SYSTEM:\n" + SYSTEM_PROMPTS[prompt]), F.concat(F.lit("USER:\n"), user), F.lit("ASSISTANT:\n"))


def sentence(slot: Column, name: Column, value: Column) -> Column:
    """P10: by slot; null for a slot that is not listed."""
    out = None
    for s, template in CANDIDATE_SENTENCES.items():
        text = filled(template, NAME=name, VALUE=value)
        out = F.when(slot == s, text) if out is None else out.when(slot == s, text)
    return out


def rubric(variant: str, name: Column, shared: Column, f1: Column, f2: Column) -> Column:
    """P11."""
    wording, order, weights = RUBRICS[variant]
    values, weigh = {"shared": shared, "f1": f1, "f2": f2}, dict(zip(("shared", "f1", "f2"), weights, strict=True))
    lines = [filled(RUBRIC_ITEMS[wording][item != "shared"], WEIGHT=F.lit(str(weigh[item])), NAME=name, VALUE=values[item]) for item in order]
    return F.concat_ws("\n", *lines)


def key_variants(answer: Column, donor: Column) -> Column:
    """The four variants of a keyed-answer family."""
    def one(v: str, kind: str) -> Column:
        flipped = kind == "counterfactual"
        return F.struct(
            F.lit(v).alias("variant_id"), F.lit(kind).alias("kind"), filled(KEY_WORDINGS[v], ANSWER=donor if flipped else answer).alias("criterion_text"),
            F.lit("s_counterfactual" if flipped else "s_base").alias("semantics_id"), F.lit("c2" if flipped else "c1").alias("gold_winner_cid"),
        )

    return F.array(*[one(v, k) for v, k in zip(KEY_WORDINGS, KINDS, strict=True)])
