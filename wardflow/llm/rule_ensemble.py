"""Quality by a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

Boosted shallow trees are grown on the statistics of labelled texts. Every path from a root to a node is a rule: a
conjunction of bounds, one interval per statistic. Lasso logistic regression over the rules' truth values keeps few of
them; its penalty is chosen by folds inside the training rows. Rules and weights become one column expression, so
scoring is a projection without Python.

Training takes at most ``PER_CLASS`` labelled texts of low quality and twice as many of high quality, the first in order
of a hash of the id; only their statistics (a dozen numbers a text) reach the driver.

Defined results: a null text is the empty text, whose statistics are all zero, and has a score like any other; without a
label of both kinds every score is 0.5, predicted 1; a text with several labels has the highest, null labels are
ignored; rows that share an id train as one (the least statistics), each has its own score; a null id counts as held
out; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import id_and_text, table
from wardflow.llm.registry import query

PER_CLASS, TREES, DEPTH, CUTS, RATE = 3000, 40, 3, 24, 0.3
THRESHOLD = 0.3
PENALTIES = (0.03, 0.01, 0.003, 0.001)  # of the lasso, in units of a row's mean loss

_COUNTS = {
    "chars": lambda t: F.length(t),
    "upper": lambda t: F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")),
    "digits": lambda t: F.regexp_count(t, F.lit("[0-9]")),
    "signs": lambda t: F.regexp_count(t, F.lit(r"[|*#%&$@~^<>{}\[\]\\/+=_`]")),
    "stops": lambda t: F.regexp_count(t, F.lit("[.;:?]")),
    "bangs": lambda t: F.regexp_count(t, F.lit("!")),
    "repeats": lambda t: F.regexp_count(t, F.lit(r"(?<![^ ])([^ \n]++)(?= \1(?![^ \n]))")),  # a word that the next one repeats
    "words": lambda t: F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), ""),
    "lines": lambda t: F.split(t, "\n"),
}


def _per(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


_STATISTICS = {
    "log_chars": lambda c: F.log1p(c["chars"]),
    "log_words": lambda c: F.log1p(c["n_words"]),
    "chars_a_word": lambda c: _per(c["chars"], c["n_words"]),
    "upper_share": lambda c: _per(c["upper"], c["chars"]),
    "digit_share": lambda c: _per(c["digits"], c["chars"]),
    "sign_share": lambda c: _per(c["signs"], c["n_words"]),
    "stop_share": lambda c: _per(c["stops"], c["n_words"]),
    "bang_share": lambda c: _per(c["bangs"], c["n_words"]),
    "repeat_share": lambda c: _per(c["repeats"], c["n_words"]),
    "distinct_words": lambda c: _per(c["n_distinct"], c["n_words"]),
    "words_a_line": lambda c: _per(c["n_words"], c["n_lines"]),
    "distinct_lines": lambda c: _per(c["n_distinct_lines"], c["n_lines"]),
}
STATISTICS = list(_STATISTICS)


def with_statistics(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with the struct column ``name`` of all statistics of a text."""
    raw = docs.withColumn(name, F.struct(*[f(text).alias(k) for k, f in _COUNTS.items()]))
    c = {k: F.col(name)[k] for k in _COUNTS}
    sizes = {
        "n_words": F.size(c["words"]), "n_distinct": F.size(F.array_distinct(c["words"])),
        "n_lines": F.when(c["chars"] > 0, F.size(c["lines"])).otherwise(F.lit(0)),
        "n_distinct_lines": F.when(c["chars"] > 0, F.size(F.array_distinct(c["lines"]))).otherwise(F.lit(0)),
    }
    counted = raw.withColumn(name, F.struct(*[c[k].alias(k) for k in _COUNTS if k not in ("words", "lines")], *[v.alias(k) for k, v in sizes.items()]))
    c = {k: F.col(name)[k] for k in [*_COUNTS, *sizes]}
    return counted.withColumn(name, F.struct(*[f(c).cast("double").alias(k) for k, f in _STATISTICS.items()]))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above, up to): a text meets it if every statistic lies in its interval."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(and_, [(x[:, j] > low) & (x[:, j] <= high) for j, low, high in self.bounds])

    def column(self, stats: Column) -> Column:
        tests = []
        for j, low, high in self.bounds:
            value = stats[STATISTICS[j]]
            tests += ([value > F.lit(low)] if low > -np.inf else []) + ([value <= F.lit(high)] if high < np.inf else [])
        return reduce(and_, tests)

    def __str__(self) -> str:
        return " and ".join([f"{low:.4g} < {STATISTICS[j]} <= {high:.4g}" for j, low, high in self.bounds])


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, stats: Column) -> Column:
        """The score as one expression over the statistics' struct."""
        parts = [F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        return 1.0 / (1.0 + F.exp(-reduce(add, parts, F.lit(self.bias))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias) + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Of every statistic the places between its values, at most ``CUTS`` quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[:-1] + values[1:]) / 2
        out.append(np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1], method="nearest")) if len(middle) > CUTS else middle)
    return out


def tree_paths(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, step: np.ndarray) -> list[dict[int, tuple[float, float]]]:
    """Paths of one tree grown on ``rows`` by the gain of second-order boosting; adds the leaves' values to ``step``."""
    paths: list[dict[int, tuple[float, float]]] = []
    nodes = [(rows, np.arange(len(x)), {}, 0)]
    while nodes:
        own, whole, path, depth = nodes.pop()
        g, h = slope[own].sum(), weight[own].sum()
        best = (1e-6, -1, -1)
        for j in range(x.shape[1]) if depth < DEPTH and len(own) >= 20 else ():
            if not len(cuts[j]):
                continue
            left_g = np.bincount(bins[own, j], weights=slope[own], minlength=len(cuts[j]) + 1).cumsum()[:-1]
            left_h = np.bincount(bins[own, j], weights=weight[own], minlength=len(cuts[j]) + 1).cumsum()[:-1]
            n = np.bincount(bins[own, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(n < 5) | (n > len(own) - 5)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        _, j, k = best
        if j < 0:
            step[whole] += RATE * g / (h + 1)
            continue
        at = float(cuts[j][k])
        low, high = path.get(j, (-np.inf, np.inf))
        for side, bounds in ((True, (low, at)), (False, (at, high))):
            longer = path | {j: bounds}
            paths.append(longer)
            nodes.append((own[(bins[own, j] <= k) == side], whole[(bins[whole, j] <= k) == side], longer, depth + 1))
    return paths


def grow(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Rules from all paths of boosted trees, each tree on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = cuts_of(x)
    bins = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    f, found = np.full(len(x), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(x))
        some = np.sort(rng.permutation(len(x))[: max(20, len(x) // 2)])
        for path in tree_paths(x, bins, cuts, y - p, p * (1 - p), some, step):
            found.add(Rule(tuple((j, low, high) for j, (low, high) in sorted(path.items()))))
        f += step
    return sorted(found, key=lambda r: r.bounds)


def lasso(truth: np.ndarray, high: np.ndarray, rows: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """Weights, bias last, of L1-penalised logistic regression by accelerated proximal steps; the bias is free.

    A row of ``truth`` stands for ``rows`` texts of which ``high`` have label 1.
    """
    x, n = np.hstack([truth, np.ones((len(truth), 1))]), rows.sum()
    rate = 4 * n / max(float(np.linalg.eigvalsh(x.T @ (rows[:, None] * x))[-1]), 1e-9)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slope = x.T @ (rows / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - high) / n
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < 1e-5
        w, t = new, t_new
        if done:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Ensemble:
    """Ensemble from statistics, labels 0 or 1 and a fold number for each row."""
    if not len(y) or y.min() == y.max():
        return Ensemble((), (), 0.0)
    rules = grow(x, y)
    truth = np.column_stack([r.holds(x) for r in rules]) if rules else np.zeros((len(x), 0), dtype=bool)
    first: dict[bytes, int] = {}
    for k in range(len(rules)):  # rules that hold for the same rows are one rule
        if 0 < truth[:, k].sum() < len(x):
            first.setdefault(truth[:, k].tobytes(), k)
    kept = sorted(first.values())
    rules, truth = [rules[k] for k in kept], truth[:, kept]
    patterns, of = np.unique(np.packbits(truth, axis=1), axis=0, return_inverse=True)  # texts of one pattern of rules are one row
    truth = np.unpackbits(patterns, axis=1, count=len(kept)).astype(float) if kept else np.zeros((len(patterns), 0))
    counts = np.zeros((int(fold.max()) + 1, len(truth), 2))
    np.add.at(counts, (fold, of.reshape(-1), y.astype(int)), 1)
    whole, loss = counts.sum(axis=0), np.zeros(len(PENALTIES))
    for out in counts:
        inside, w = whole - out, None
        if not out.any() or not inside.sum(axis=0).all():
            continue
        for i, penalty in enumerate(PENALTIES):
            w = lasso(truth, inside[:, 1], inside.sum(axis=1), penalty, w, rounds=150)
            z = np.clip(truth @ w[:-1] + w[-1], -30, 30)
            loss[i] += (out.sum(axis=1) * np.log1p(np.exp(z)) - out[:, 1] * z).sum()
    w = lasso(truth, whole[:, 1], whole.sum(axis=1), PENALTIES[int(loss.argmin())], rounds=2000)
    used = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Ensemble(tuple(rules[k] for k in used), tuple(float(w[k]) for k in used), float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Ensemble:
    """Ensemble from the labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    known = known.where("label_id is not null and crc32(cast(label_id as string)) % 5 <> 0").withColumn("h", F.xxhash64("label_id"))
    picked = known.where("label = 0").orderBy("h").limit(per_class).unionByName(known.where("label = 1").orderBy("h").limit(2 * per_class))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(picked.select("label_id", "label")), F.col("id") == F.col("label_id"))  # at most 3 * per_class rows
    stats = with_statistics(rows, F.col("text"), "stats").groupBy("id").agg(F.max("label").alias("label"), F.min("stats").alias("stats"))
    sample = sorted(stats.select("id", F.col("label").cast("double"), "stats").collect(), key=lambda r: r.id)  # numbers only, at most 3 * per_class rows
    x = np.array([list(r.stats) for r in sample], dtype=float).reshape(-1, len(STATISTICS))
    fold = np.array([zlib.crc32(str(r.id).encode()) // 5 % 4 for r in sample], dtype=int)
    return fit(x, np.array([r.label for r in sample], dtype=float), fold)


def scored(docs: DataFrame, ensemble: Ensemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs``, all columns, with the score under ``name`` (replacing a column of that name)."""
    stats = "_stats"
    while stats in docs.columns:
        stats += "_"
    return with_statistics(docs, F.coalesce(F.col(text_col), F.lit("")), stats).withColumn(name, ensemble.column(F.col(stats))).drop(stats)


def score_documents(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    found = scored(id_and_text(docs, id_col, text_col), ensemble)
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return found.select(F.col("id").cast("long").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op13_rule_ensemble")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_documents(docs, learn(docs, table(spark, folder, "labels")))
