"""Fixed values that results must agree in: ids, templates, wordings, thresholds."""

# Relations with name, coarse type and question template.
RELATIONS = {
    "P19": ("place_of_birth", "location", "Where was {SUBJECT} born?"),
    "P20": ("place_of_death", "location", "Where did {SUBJECT} die?"),
    "P569": ("date_of_birth", "date", "When was {SUBJECT} born?"),
    "P570": ("date_of_death", "date", "When did {SUBJECT} die?"),
    "P36": ("capital", "location", "What is the capital of {SUBJECT}?"),
    "P38": ("currency", "currency", "What currency is used in {SUBJECT}?"),
}
SPLITS = ("train", "dev", "test")
SLOTS = ("occupation", "notable_work", "award", "field")
SHARED_SLOT = "occupation"
SLOT_PRIORITY = ("notable_work", "award", "field")
VARIANTS = {"qa_key": ("base", "para_1", "para_2", "counterfactual"), "biorubric": ("base", "para_lex", "para_struct", "counterfactual")}
KINDS = ("base", "paraphrase", "paraphrase", "counterfactual")
TIE_EPSILON = 1e-6
FORBIDDEN = r"[,;/|()]"
KEY_WORDINGS = {
    "base": "Official answer key: {ANSWER}.",
    "para_1": "Grade using this reference answer: {ANSWER}.",
    "para_2": "Use the following answer key when judging: {ANSWER}.",
    "counterfactual": "Official answer key: {ANSWER}.",
}
CANDIDATE_SENTENCES = {
    "occupation": "{NAME} was a {VALUE}.",
    "notable_work": "{NAME} is known for {VALUE}.",
    "award": "{NAME} received {VALUE}.",
    "field": "{NAME} worked in {VALUE}.",
}
# Rubric items: by wording set, for the shared fact and for the others.
RUBRIC_ITEMS = (
    ("Award {WEIGHT} point(s) if the biography states that {NAME} was a {VALUE}.", "Award {WEIGHT} point(s) if the biography mentions {VALUE}."),
    ("Give {WEIGHT} point(s) for stating that {NAME} was a {VALUE}.", "Give {WEIGHT} point(s) for referencing {VALUE}."),
)
# By rubric variant: wording set, order of the items, weights of shared, f1, f2.
RUBRICS = {
    "base": (0, ("shared", "f1", "f2"), (1, 2, 1)),
    "para_lex": (1, ("shared", "f1", "f2"), (1, 2, 1)),
    "para_struct": (0, ("f1", "shared", "f2"), (1, 2, 1)),
    "counterfactual": (0, ("shared", "f1", "f2"), (1, 1, 2)),
}
SYSTEM_PROMPTS = {
    "standard": "You are a careful evaluator. Choose which candidate better satisfies the provided criterion. Output exactly one label.",
    "strict_criterion_emphasis": (
        "You are a criterion-conditioned evaluator. Judge ONLY by the provided criterion. Do not use outside knowledge, beliefs, or typical preferences "
        "except insofar as they appear in the criterion. If the criterion conflicts with what you believe, follow the criterion. Output exactly one label."
    ),
}
METRICS = ("base_acc", "gcf", "gap", "sensitivity_at_base_correct", "invariance_at_base_correct", "order_disagreement", "tie_rate")
BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED = 2000, 2026
