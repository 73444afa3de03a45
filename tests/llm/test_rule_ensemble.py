"""Rule ensemble: compiled columns against plain Python, held-out accuracy, odd inputs."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from wardflow.llm import rule_ensemble as rules


def plain_statistics(t):
    words, lines = [w for w in re.split("[\x20\x09-\x0D]+", t) if w], t.split("\n") if t else []
    per = lambda a, b: a / b if b else 0.0
    signs, repeats = len(re.findall(r"[|*#%&$@~^<>{}\[\]\\/+=_`]", t)), len(re.findall(r"(?<![^ ])([^ \n]+)(?= \1(?![^ \n]))", t))
    return [
        math.log1p(len(t)), math.log1p(len(words)), per(len(t), len(words)), per(len(re.findall("[A-ZÀ-ÖØ-Þ]", t)), len(t)), per(len(re.findall("[0-9]", t)), len(t)), per(signs, len(words)),
        per(len(re.findall("[.;:?]", t)), len(words)), per(t.count("!"), len(words)), per(repeats, len(words)), per(len(set(words)), len(words)), per(len(words), len(lines)), per(len(set(lines)), len(lines)),
    ]


def some_texts(n=900, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfghij") for _ in range(rng.randint(1, 8)))
    out = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        kind = k % 5
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " | ".join(words)
        else:
            text = " ".join(words).capitalize() + ".\n" + " ".join(words[:5])
        out.append((k, text, int(kind > 1)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(k, t, 5) for k, t, _ in rows], "doc_id long, text string, chars int")
    return docs, spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")


def test_statistics(spark):
    texts = ["", "a", "A a a a b b", "x x\nx x\n\n x", "|%|\t9.9 É!", "word " * 50_000, "z" * 300_000, "a b a b", " lead", "tail \n", "Et Et Et."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.s) for r in rules.with_statistics(df, F.col("t"), "s").select("i", "s").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(t)), t[:20]


def test_held_out_accuracy_and_compiled_rules(spark):
    rows = some_texts()
    docs, labels = tables(spark, rows)
    ensemble = rules.learn(docs, labels)
    found = {r.doc_id: r for r in rules.score_documents(docs, ensemble).collect()}
    truth = {k: q for k, _, q in rows}
    held = [r for r in found.values() if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert 0 < len(ensemble.rules) < 60 and all(str(r) for r in ensemble.rules)
    want = ensemble.scores(np.array([plain_statistics(t) for _, t, _ in rows]))
    assert np.allclose([found[k].score for k, _, _ in rows], want, atol=1e-9)
    plan = rules.score_documents(docs, ensemble)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows_and_labels(spark):
    rows = some_texts(200)
    docs, labels = tables(spark, rows)
    odd = spark.createDataFrame([(None, None, 1), (None, "", 1), (3, "x " * 100_000, 1), (3, rows[3][1], 1), (3, rows[3][1], 1)], "doc_id long, text string, chars int")
    more = labels.unionByName(spark.createDataFrame([(3, None, 1), (3, 1, 1), (None, 0, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int"))
    everything = docs.unionByName(odd)
    got = rules.score_documents(everything, rules.learn(everything, more)).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None) and len({r.score for r in got if r.doc_id is None}) == 1
    for known in (labels.where("quality = 1"), labels.limit(0)):
        assert {(r.score, r.predicted) for r in rules.score_documents(docs, rules.learn(docs, known)).collect()} == {(0.5, 1)}
    assert rules.score_documents(docs.limit(0), rules.learn(docs.limit(0), labels)).count() == 0


def test_tables_of_documents(spark):
    """Held-out accuracy on the supplied labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = rules.score_documents(docs, rules.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) > 0.9
    assert np.mean([r.predicted for r in found if r.quality == 1]) > 0.97
