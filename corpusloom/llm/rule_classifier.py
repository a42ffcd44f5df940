"""Quality classifier as a sparse ensemble of rules.

Boosted trees over text statistics give their root-to-node paths as conjunctive rules; a lasso logistic regression
keeps few of them; the kept rules and weights become one Spark column expression.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, fresh, table
from corpusloom.llm.labels import labelled_sample
from corpusloom.llm.stats import FIELDS, text_stats

N_TREES, DEPTH, SHRINK, MIN_LEAF, BINS = 40, 3, 0.3, 20, 48

#: statistic: (numerator, denominator), 0 where the denominator is; a denominator of None is the count itself
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, whether it is above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = True
        for name, above, at in self.terms:
            out = out & ((x[name] > at) if above else (x[name] <= at))
        return out

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & ((x[name] > F.lit(at)) if above else (x[name] <= F.lit(at)))
        return out


@dataclass
class RuleModel:
    intercept: float = 0.0
    weights: list[tuple[float, Rule]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as a column over the struct of statistics."""
        x = feature_columns(stats)
        z = F.lit(float(self.intercept))
        for w, rule in self.weights:
            z = z + F.when(rule.column(x), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def add_score(self, df: DataFrame, stats: Column, name: str) -> DataFrame:
        """df with the same score as a column ``name``: the rules are a constant table that one small expression adds up.

        As a sum of as many conditions they would be a class of generated code that a driver can hardly compile.
        """
        x, order = fresh(df, "rule_features"), list(FEATURES)
        # an array of its own, and not known beforehand: else it would be made anew for each term, also in a filter on the score
        start = F.lit(float(self.intercept)) + 0.0 * F.spark_partition_id()
        out = df.withColumn(x, F.array(*feature_columns(stats).values(), start))
        rules = [{"w": float(w), "terms": [{"i": order.index(n) + 1, "above": a, "at": float(t)} for n, a, t in rule.terms]} for w, rule in self.weights]
        table = F.from_json(F.lit(json.dumps(rules)), "array<struct<w:double,terms:array<struct<i:int,above:boolean,at:double>>>>")
        holds = lambda r: F.forall(r["terms"], lambda t: (F.element_at(x, t["i"]) > t["at"]) == t["above"])
        z = F.aggregate(table, F.element_at(x, -1), lambda acc, r: acc + F.when(holds(r), r["w"]).otherwise(0.0))
        return out.withColumn(name, 1.0 / (1.0 + F.exp(-z))).drop(x)

    def predict(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        z = np.full(n, self.intercept)
        for w, rule in self.weights:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def feature_columns(s: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))
    return {name: s[a].cast("double") if b is None else ratio(a, b) for name, (a, b) in FEATURES.items()}


def feature_arrays(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (a, b) in FEATURES.items():
        top = stats[a].astype(float)
        out[name] = top if b is None else np.divide(top, stats[b], out=np.zeros(len(top)), where=stats[b] > 0)
    return out


def _tree_rules(x: dict[str, np.ndarray], cuts: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree fitted to gradients, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(g))
    todo = [(np.arange(len(g)), ())]
    while todo:
        rows, terms = todo.pop()
        if terms:
            rules.append(Rule(terms))
        best = (1e-6, "", 0.0)
        if len(terms) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for name, at in cuts.items():
                place = np.searchsorted(at, x[name][rows], side="left")  # x <= at[place]
                n, gs, hs = (np.bincount(place, w, len(at) + 1).cumsum()[:-1] for w in (None, g[rows], h[rows]))
                fit = (n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF)
                gain = np.where(fit, gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), name, float(at[gain.argmax()]))
        if best[1]:
            low = x[best[1]][rows] <= best[2]
            todo += [(rows[low], (*terms, (best[1], False, best[2]))), (rows[~low], (*terms, (best[1], True, best[2])))]
        else:
            step[rows] = SHRINK * g[rows].sum() / (h[rows].sum() + 1)
    return rules, step


def _lasso(m: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty by accelerated proximal gradient; the intercept goes free."""
    n, k = m.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(m, 2) ** 2 / n + 1)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(m @ v + c))) - y
        w2 = v - rate * (m.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * strength, 0)
        b2 = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit(stats: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    """Without rows every score is 0.5, with one label only its smoothed share."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    model = RuleModel(float(np.log(share / (1 - share))))
    if n < 4 * MIN_LEAF or y.min() == y.max():
        return model
    x = feature_arrays(stats)
    cuts = {name: np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for name, v in x.items()}
    z, rules = np.full(n, model.intercept), []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-z))
        more, step = _tree_rules(x, cuts, y - p, p * (1 - p))
        rules += more
        z += step
    seen, columns, kept = set(), [], []
    for rule in dict.fromkeys(rules):
        mask = rule.holds(x)
        if mask.tobytes() not in seen and 0 < mask.sum() < n:
            seen.add(mask.tobytes())
            columns.append(mask)
            kept.append(rule)
    m = np.array(columns, float).T
    mean, scale = m.mean(0), m.std(0)
    m = (m - mean) / scale
    inner = np.arange(n) % 5 > 0
    losses = {}
    for strength in (0.03, 0.01, 0.003, 0.001):
        b, w = _lasso(m[inner], y[inner], strength)
        p = np.clip(1 / (1 + np.exp(-(m[~inner] @ w + b))), 1e-6, 1 - 1e-6)
        losses[strength] = -(y[~inner] * np.log(p) + (1 - y[~inner]) * np.log(1 - p)).mean()
    b, w = _lasso(m, y, min(losses, key=losses.get))
    model.intercept = float(b - (w * mean / scale).sum())
    model.weights = [(float(wi / si), rule) for wi, si, rule in zip(w, scale, kept, strict=True) if wi]
    return model


def train(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Fits on a sample (labels.SAMPLE_ROWS) of labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    sample = labelled_sample(docs, labels, "quality", crc_mod(F.col("doc_id"), 4) != 2)
    got = sample.select("doc_id", "y", text_stats(F.col("text")).alias("s")).select("doc_id", "y", *(F.col("s")[f].alias(f) for f in FIELDS)).toArrow().sort_by("doc_id")
    return fit({f: got[f].to_numpy() for f in FIELDS}, (got["y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """All rows and columns of docs (text among them) with the probability that quality is 1.

    Where docs has a column ``name``, in any case of letters, underscores are added to the new one's. Null and empty
    texts are scored by the statistics of an empty text, repeated rows alike; an empty table stays so.
    """
    stats = fresh(docs, "text_stats")
    return model.add_score(docs.withColumn(stats, text_stats(F.col("text"))), F.col(stats), fresh(docs, name)).drop(stats)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
