"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardflow.llm import spelling


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(rows):
    words = plain_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [x for x in words if x != w and one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def some_rows(seed=4, letters="abcdé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 8, 40])
        for _ in range(6):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            v = w[:at] + {0: "", 1: w[at] + rng.choice(letters), 2: rng.choice(letters), 3: w[at:][::-1]}[kind] + (w[at + 1 :] if kind < 3 else "")
            words += [v] * rng.choice([2, 3, 5, 17])
    words += ["x" * 300] * 4 + ["x" * 301] * 9 + ["ÀÿØ×÷ß"] * 3
    rng.shuffle(words)
    rows = [(i % 70, " ".join(words[k : k + 9]) + rng.choice([".", "1Abc", ""])) for i, k in enumerate(range(0, len(words), 9))]
    return rows + [(None, "abcab abcab abcab"), (None, None), (3, ""), (5, "abcab ABCAB abcaB"), (5, "abcab ABCAB abcaB"), (9, "a1b2 " * 2000 + "Éabcd")]


@pytest.mark.parametrize("letters", ["abcdé", "ab"])
def test_forms(spark, letters):
    rows = some_rows(letters=letters)
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, word double").repartition(3)
    got = {tuple(r) for r in spelling.spelling_forms(docs).collect()}
    want = plain_forms(rows)
    assert got == want and sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


def test_many_shards_find_the_same_pairs(spark):
    """Trees with many cells, from a sample, with parts for anagrams that no box separates."""
    rng = random.Random(8)
    words = {"".join(rng.sample("abcdefg", 7)) for _ in range(700)} | {"".join(rng.choice("abcde") for _ in range(rng.choice([5, 6, 6, 7]))) for _ in range(2500)}
    counts = {w: rng.randint(3, 9) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    cells = spelling.plan_cells(sorted(words), 1, 40)
    assert max(max(c.parts) for c in cells.values()) > 3 and all(len(c.parts) > 8 for c in cells.values())
    assert spelling.deal(table, cells).where("role = 0").count() == len(words)
    listed = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            listed[w] |= {w[:i] + c + w[i + 1 :] for c in "abcdefg"} | {w[:i] + w[i + 1 :]}
        for i in range(len(w) + 1):
            listed[w] |= {w[:i] + c + w[i:] for c in "abcdefg"}
        listed[w] = (listed[w] & words) - {w}
    want = {(w, len(x), -min((-counts[y], y) for y in x)[0], min((-counts[y], y) for y in x)[1]) for w, x in listed.items() if x}
    assert {tuple(r) for r in spelling.near_words(table, shard=40, sample=600).collect()} == want


def test_box_search_loses_nothing():
    rng = np.random.default_rng(2)
    counts = np.zeros((900, 90), dtype=np.int32)
    counts[:, :6] = rng.integers(0, 4, (900, 6))
    root, leaves = spelling.build(counts, 10)
    assert len(leaves) > 40 and sorted(np.concatenate([x.rows for x in leaves]).tolist()) == list(range(900))
    for radius in (0, 1, 2):
        met, visited = set(), 0
        for leaf, rows in spelling.reach(root, counts[:100], radius):
            visited += len(rows)
            met |= {(i, j) for i in rows.tolist() for j in leaf.rows.tolist()}
        near = np.abs(counts[:100, None] - counts[None]).sum(axis=2) <= radius
        assert {tuple(x) for x in np.argwhere(near).tolist()} <= met and visited < 100 * len(leaves) * 0.8


def test_edit_checks():
    pairs = [("abcde", "abcdf"), ("abcde", "abced"), ("abcde", "abcde"), ("aabaa", "aaaaa")]
    assert spelling.one_replaced(spelling.letter_rows([a for a, _ in pairs]), spelling.letter_rows([b for _, b in pairs])).tolist() == [one_edit(a, b) for a, b in pairs]
    pairs = [("aaaa", "aaaab"), ("abcd", "xabcd"), ("abcd", "abxcd"), ("abcd", "abdcx"), ("aaaa", "aaaaa"), ("abcd", "acbde")]
    assert spelling.one_inserted(spelling.letter_rows([a for a, _ in pairs]), spelling.letter_rows([b for _, b in pairs])).tolist() == [one_edit(a, b) for a, b in pairs]
