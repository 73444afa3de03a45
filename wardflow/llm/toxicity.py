"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

A text is taken as its segments: words without outer punctuation (long ones in overlapping windows), and runs of single
characters set apart by spaces, joined. The kernel of two segments sums over all subsequences of four symbols within
``REACH`` positions, each weighted ``DECAY`` to the positions it spans, so letters set apart or doubled still share
most subsequences with the plain word. Landmarks are segments; the Nystrom map makes the machine linear in the kernel
values at the landmarks, hence linear in the landmarks' subsequences: a segment's margin is a sum over its
subsequences of one weight each, looked up in a table.

Labels are per text, so training picks the segments: the highest of each toxic text against segments of the others,
the hardest among them, in rounds, with copies that have characters inserted. A text's score is the logistic of its
highest margin and of how many segments, and how large a part of them, have a positive one.

Training takes at most ``PER_CLASS`` toxic labelled texts and twice as many others, the first in order of a hash of the id. Defined
results: a null, empty or blank text has the score of a text without segments; without a label of both kinds every
score is 0.5 - a hair, predicted 0; texts with several labels are toxic if one says so, null labels are ignored;
repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import filter_rows, give_back, id_and_text, slices, table
from wardflow.llm.registry import query

DECAY, REACH, LONGEST = 0.8, 7, 24
LANDMARKS, PER_CLASS, ROUNDS = 160, 3000, 3
OFFSETS = [(a, b, c) for a, b, c in combinations(range(1, REACH), 3)]
CHUNK_SEGMENTS = 20_000

_CODE = np.array([0] + [39 + i % 25 for i in range(1, 1024)], dtype=np.uint32)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = np.arange(27, 37)
_CODE[2], _CODE[3] = 37, 38  # start and end of a segment
_OUTER = " \t\n.,;:!?\"'()[]{}<>|*_#$%&/\\-+=~`"
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\w(?: \w(?!\S)){2,}")


def windows(word: str) -> list[str]:
    """The word without outer punctuation, and without inner punctuation if it has some."""
    word = word.strip(_OUTER)
    if word.isalnum():
        return _cut(word)
    plain = _INNER.sub("", word)
    return _cut(word) + (_cut(plain) if plain != word else [])


def _cut(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def segments(text: str) -> list[str]:
    """Distinct segments of a text."""
    low = text.lower()
    out = {w for word in set(low.split()) for w in windows(word)}
    out.update(w for m in _SPACED.finditer(low) for w in windows(m[0].replace(" ", "")))
    return sorted(out)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol codes below 64, index of the word) with zeros between words."""
    raw = np.frombuffer("".join([f"\2{w}\3" + "\0" * REACH for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(raw < 1024, _CODE[np.minimum(raw, 1023)], 39 + raw % 25).astype(np.uint32)
    return code, np.repeat(np.arange(len(words)), [len(w) + 2 + REACH for w in words])


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(subsequence codes, index of the word, weight), one part for each shape of gaps."""
    code, word = symbols(words)
    n = len(code) - REACH
    real = np.flatnonzero(code[:n])
    of, first = word[real], code[real] << 18
    for a, b, c in OFFSETS:
        last = code[real + c]
        ok = last > 0
        at = real[ok]
        yield first[ok] | code[at + a] << 12 | code[at + b] << 6 | last[ok], of[ok], DECAY ** (c + 1)


class Landmarks:
    """Subsequences of the landmarks, as a table from code to row, and each row's weight in each landmark."""

    def __init__(self, words: list[str]):
        codes, of, weights = (np.concatenate(x) for x in zip(*((c, w, np.full(len(c), v)) for c, w, v in subsequences(words)), strict=True))
        self.codes, row = np.unique(codes, return_inverse=True)
        self.phi = np.zeros((len(self.codes), len(words)))
        np.add.at(self.phi, (row, of), weights)
        self.phi /= np.sqrt((self.phi**2).sum(axis=0))
        self.table = np.zeros(1 << 24, dtype=np.int32)
        self.table[self.codes] = np.arange(1, len(self.codes) + 1)
        values, vectors = np.linalg.eigh(self.phi.T @ self.phi)
        self.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def features(self, words: list[str]) -> np.ndarray:
        """Nystrom features."""
        out = np.zeros((len(words), self.phi.shape[1]))
        for at in range(0, len(words), 2000):
            found = []
            for codes, of, weight in subsequences(words[at : at + 2000]):
                row = self.table[codes]
                hit = np.flatnonzero(row)
                found.append((of[hit], row[hit] - 1, np.full(len(hit), weight)))
            of, row, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(of, kind="stable")
            names, start = np.unique(of[order], return_index=True)
            if len(names):
                out[at + names] = np.add.reduceat(self.phi[row[order]] * weight[order, None], start, axis=0)
        return out @ self.whiten


def margins(words: list[str], codes_table: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias)
    for at in range(0, len(words), CHUNK_SEGMENTS):
        some = words[at : at + CHUNK_SEGMENTS]
        for codes, of, weight in subsequences(some):
            row = codes_table[codes]
            hit = np.flatnonzero(row)
            out[at : at + len(some)] += np.bincount(of[hit], weights=weights[row[hit]] * weight, minlength=len(some))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, bias last, of the squared-hinge machine by Newton steps; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active]
        hessian = ridge * np.eye(len(w)) + a.T @ (cost[active, None] * a)
        new = np.linalg.solve(hessian, a.T @ (cost[active] * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, bias last; y is 1 or 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(ridge * np.eye(len(w)) + x.T @ ((p * (1 - p) + 1e-9)[:, None] * x), x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def inserted(word: str, rng: np.random.Generator) -> str:
    """The word with characters inserted or doubled."""
    kind = rng.integers(4)
    if kind == 0:
        return ".-*_"[rng.integers(4)].join(word)
    if kind == 1:
        return "".join(c * int(rng.integers(1, 4)) for c in word)
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + ".-*x1"[rng.integers(5)] + word[at:]


class Model:
    """What a worker needs: landmark subsequences with their weights, bias, and the logistic of a text."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, logistic: np.ndarray):
        self.codes, self.weights, self.bias, self.logistic, self._table = codes, weights, bias, logistic, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def margins(self, words: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << 24, dtype=np.int32)
            self._table[self.codes] = np.arange(1, len(self.codes) + 1)
        return margins(words, self._table, np.concatenate(([0.0], self.weights)), self.bias)

    def free(self) -> None:
        """Drop the lookup table; the next call makes it again."""
        self._table = None

    def scores(self, texts: list[str]) -> np.ndarray:
        each = [segments(t) for t in texts]
        listed = sorted(set().union(*each))
        place = dict(zip(listed, range(len(listed)), strict=True))
        value = self.margins(listed)
        x = text_features([value[[place[w] for w in words]] for words in each])
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def text_features(each: list[np.ndarray]) -> np.ndarray:
    """Highest margin (clipped), log count of positive margins and of their number in 50 segments."""
    top = np.array([np.clip(m.max(initial=-3.0), -3, 3) for m in each])
    above, n = np.array([float((m > 0).sum()) for m in each]), np.array([float(max(1, len(m))) for m in each])
    return np.column_stack([top, np.log1p(above), np.log1p(50 * above / n)])


def first_values(listed: list[str], texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Of every segment the log-odds of its best plain run of four symbols, -9 if it has none that toxic texts share."""
    code, word = symbols(listed)
    n = len(code) - 3
    real = np.flatnonzero((code[:n] > 0) & (code[3:] > 0))
    runs, run = np.unique(code[real] << 18 | code[real + 1] << 12 | code[real + 2] << 6 | code[real + 3], return_inverse=True)
    of = word[real]
    begin = np.searchsorted(of, np.arange(len(listed) + 1))
    df = np.zeros((2, len(runs)))
    for places, bad in zip(texts, toxic, strict=True):
        inside = np.concatenate([np.arange(begin[w], begin[w + 1]) for w in places.tolist()] or [np.empty(0, np.int64)])
        df[int(bad), np.unique(run[inside])] += 1
    n_bad, n_good = toxic.sum(), (~toxic).sum()
    odds = np.log((df[1] + 0.5) / (n_bad + 1)) - np.log((df[0] + 0.5) / (n_good + 1))
    odds[df[1] < max(2, 0.003 * n_bad)] = -9.0
    out = np.full(len(listed), -9.0)
    np.maximum.at(out, of, odds[run])
    return out


def train(texts: list[list[str]], toxic: np.ndarray, seed: int = 5) -> Model:
    """Model from the segments of labelled texts."""
    rng = np.random.default_rng(seed)
    nothing = Model(np.empty(0, np.int64), np.empty(0), -1.0, np.array([0.0, 0.0, 0.0, -1e-6]))
    if not toxic.any() or toxic.all():
        return nothing
    index: dict[str, int] = {}
    texts = [np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int32) for words in texts]
    names = np.array(sorted(index), dtype=object)
    rank = np.empty(len(index), dtype=np.int32)
    rank[[index[w] for w in names]] = np.arange(len(names))
    listed, texts = names.tolist(), [np.sort(rank[t]) for t in texts]
    del index, rank, names
    bad_texts = [t for t, bad in zip(texts, toxic, strict=True) if bad and len(t)]
    good = np.zeros(len(listed), dtype=bool)
    for t, bad in zip(texts, toxic, strict=True):
        good[t] |= not bad
    good_places = np.flatnonzero(good)
    seen_in = np.bincount(np.concatenate([*bad_texts, np.empty(0, np.int32)]), minlength=len(listed))
    value, cut = first_values(listed, texts, toxic), 1.0
    in_bad = np.flatnonzero(seen_in)
    likely = in_bad[np.argsort(-value[in_bad], kind="stable")[: 20 * LANDMARKS]]
    likely = likely[np.argsort(-value[likely] * np.log1p(seen_in[likely]), kind="stable")]
    lands, used = [], Counter()
    for w in (listed[i] for i in likely):  # landmarks that begin alike are kept few
        if len(w) > 2 and used[w[:3]] < 6 and len(lands) < LANDMARKS * 3 // 4:
            used[w[:3]] += 1
            lands.append(w)
    spare = [i for i in good_places if len(listed[i]) > 2]
    lands += [listed[i] for i in rng.choice(spare, min(LANDMARKS - len(lands), len(spare)), replace=False)] if spare else []
    if not lands:
        return nothing
    marks = Landmarks(lands)
    for _ in range(ROUNDS):
        chosen: Counter[int] = Counter()
        for t in bad_texts:
            best = t[np.argsort(-value[t], kind="stable")[:3]].tolist()
            chosen.update(w for i, w in enumerate(best) if value[w] > cut and (i == 0 or seen_in[w] > 2))
        positive = sorted(w for w in chosen if not good[w])
        hard = good_places[np.argsort(-value[good_places], kind="stable")[:2500]]
        negative = sorted({*hard.tolist(), *rng.choice(good_places, min(4000, len(good_places)), replace=False).tolist()}) if len(good_places) else []
        plain = [listed[i] for i in positive + negative]
        y = np.tile([1.0] * len(positive) + [-1.0] * len(negative), 2)
        share = np.tile(np.sqrt([*(float(chosen[w]) for w in positive), *(1.0 for _ in negative)]), 2)  # a segment counts more the more texts it was chosen in
        for sign in (1, -1):
            share[y == sign] *= len(y) / max(1.0, 2 * share[y == sign].sum())
        w = fit_machine(marks.features(plain + [inserted(x, rng) for x in plain]), y, share)
        model = Model(marks.codes, marks.phi @ (marks.whiten @ w[:-1]), float(w[-1]), np.zeros(4))
        value, cut = model.margins(listed), 0.0
    model.logistic = fit_logistic(text_features([value[t] for t in texts]), toxic.astype(float))
    return model


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Model from the labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    known = known.where("label_id is not null and crc32(cast(label_id as string)) % 5 <> 0").withColumn("h", F.xxhash64("label_id"))
    picked = known.where("label = 1").orderBy("h").limit(per_class).unionByName(known.where("label = 0").orderBy("h").limit(2 * per_class))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(picked.select("label_id", "label")), F.col("id") == F.col("label_id"))  # at most 3 * per_class rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([segments(t) for t in some.column(2).to_pylist()], pa.list_(pa.string()))], names=["id", "label", "words"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = {i: (label, words) for batch in batches for i, label, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)}
        ordered = [each[i] for i in sorted(each)]
        del each
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([w for _, w in ordered], np.array([label == 1 for label, _ in ordered], dtype=bool)))])], names=["model"])
        del ordered
        give_back()

    words = rows.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(split, "id long, label int, words array<string>")
    fitted = words.repartition(1).sortWithinPartitions("id", "words").mapInArrow(fit, "model binary").first()  # the sample is bounded, so one task has it
    return pickle.loads(fitted[0]) if fitted else train([], np.empty(0, dtype=bool))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                value = shared.value.scores(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    some.column(0).cast(pa.int64()), pa.array([is_held_out(i) for i in some.column(0).to_pylist()], pa.bool_()), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])
        shared.value.free()
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def harmless(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda: lambda texts: (shared.value.scores(texts) < 0.5).tolist() if texts else [], lambda: shared.value.free())


@query("op7_subsequence_kernel_machine")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_documents(docs, learn(docs, table(spark, folder, "labels")))
