"""Fixed values shared by the operators.

Everything in this file has to keep these exact values for results to agree with published
runs; every one of them can be overridden by an argument of the operator that uses it.
"""

# --- fixed values: class list of the study -------------------------------------------------
LABEL_NAMES = {0: "hate_speech", 1: "offensive_language", 2: "neither"}
CLASS_NAMES = ("hate_speech", "offensive_language", "neither")
MINORITY_LABELS = (0, 2)

# --- fixed values: split, sampling and rebalancing -----------------------------------------
SEED = 42
TRAIN_PERCENT = 70
VAL_PERCENT = 15
CLUSTERS = 6
FEW_SHOT = 5
SEEDS_PER_CLUSTER = 20
MIN_SEEDS = 5
VARIANTS_PER_ROUND = 10
MIN_CHARS = 5
MAX_CHARS = 280
TOP_UP_SEED_SHIFT = 9999
FILL_SEED_SHIFT = 77777
PATCH_SEED_SHIFT = 99999
SILHOUETTE_K = (2, 10)

# --- fixed values: priors, tests, training -------------------------------------------------
PRIOR_FLOOR = 1e-8
NORM_FLOOR = 1e-8
ALPHA = 0.05
PATIENCE = 12
MIN_DELTA = 1e-4
BATCH_ROWS = 32
RECALL_GRID = 200

# --- fixed values: outcomes of a test without a winner ------------------------------------------
SAME_PREDICTIONS = "tie (identical predictions)"
NO_DIFFERENCE = "no significant difference"

# --- fixed values: style grid ---------------------------------------------------------------
TONES = ("aggressive", "passive-aggressive", "sarcastic", "cold", "direct")
LENGTHS = ("very short (under 10 words)", "short (10-20 words)", "medium (20-40 words)")
FORMALITIES = ("very informal", "informal", "semi-formal")
TYPOS = ("some intentional typos", "no typos")
SYNTAXES = (
    "simple sentences",
    "fragmented sentences",
    "rhetorical questions",
    "imperative sentences",
)

# --- fixed values: patterns that mark a lower-cased line as model chatter, by reason ----------
REJECTED = {
    "disclaimer": r"(i (cannot|can't|won't)|this (is|content)|as an ai|i apologize|please note|disclaimer|warning:)",
    "apology": r"(i'm sorry|sorry,)",
    "refusal": r"(i understand|instead of|that is harmful|not appropriate|healthy discussion|promote respect)",
}

# --- fixed values: metric names and their table headings -------------------------------------
MAIN_METRICS = (
    ("accuracy", "Accuracy"),
    ("precision_macro", "Prec. Macro"),
    ("recall_macro", "Rec. Macro"),
    ("f1_macro", "F1 Macro"),
    ("precision_weighted", "Prec. Weighted"),
    ("recall_weighted", "Rec. Weighted"),
    ("f1_weighted", "F1 Weighted"),
    ("roc_auc_macro", "ROC-AUC"),
    ("pr_auc_macro", "PR-AUC"),
)
CHART_METRICS = ("f1_macro", "f1_weighted", "accuracy", "f1_hate_speech", "roc_auc_macro")
FOCUS_CLASS = "hate_speech"
FOCUS_SUFFIX = "HS"


def focus_metrics(name: str = FOCUS_CLASS, suffix: str = FOCUS_SUFFIX):
    """Metric names and headings of the one-class focus table."""
    return (
        (f"precision_{name}", f"Prec. ({suffix})"),
        (f"recall_{name}", f"Rec. ({suffix})"),
        (f"f1_{name}", f"F1 ({suffix})"),
    )
