"""The pipeline's near-duplicate stage against brute force over exact five-word shingle sets."""

import random

import pytest

import corpus_pipeline
from wardflow.llm import near_dedup


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def stay(rows):
    """Rows (id, text), ids without repeats: the least id of every component of pairs of similarity 0.8 or more."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}, len(pairs)


def families(seed=3):
    """Texts, each with copies from which more and more words differ: similarities about 0.6 to 1."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts = []
    for _ in range(50):
        words = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.022, 0.025, 0.04):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts + ["", None, " \n", "one two three", "One two THREE", "one two four"]


def test_all_similar_pairs_are_found(spark):
    rows = list(enumerate(families()))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    want, pairs = stay(rows)
    assert pairs > 300 and kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_rows_go_by_their_own_key(spark):
    """Null ids, ids with two texts, and repeated rows: only copies go."""
    texts = families(5)
    a, b, c, d, e = texts[0], texts[7], texts[14], texts[21], texts[28]
    rows = [(None, a, 1), (None, b, 1), (None, c, 1), (3, a, 1), (4, d, 1), (4, e, 1), (2, d, 1), (9, c, 1), (9, c, 1), (None, None, 1), (None, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(False, 3, a), (False, 2, d), (False, 4, e), (True, 0, b), (False, 9, c), (True, 0, "")])


def shared_passages(n, seed=7, own=50):
    """Texts that share a passage of 200 words and have some of their own: no pair reaches 0.8, but for a few copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage = " ".join(word() for _ in range(200))
    texts = [" ".join(word() for _ in range(own)) + " " + passage for _ in range(n)]
    for k in range(0, n, 50):  # near copies among them
        texts += [texts[k] + " " + " ".join(word() for _ in range(extra)) for extra in (3, 20)]
    return texts


def counted_pairs(monkeypatch, spark, texts):
    seen, verify = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, sets: seen.append(pairs.count()) or verify(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in near_dedup.keep_one(docs).collect()}, sum(seen)


@pytest.mark.parametrize("own", [50, 24])
def test_a_shared_passage_does_not_make_all_pairs(monkeypatch, spark, own):
    few, many = shared_passages(150, own=own), shared_passages(600, own=own)
    kept, small = counted_pairs(monkeypatch, spark, few)
    assert kept == stay(list(enumerate(few)))[0]
    kept, large = counted_pairs(monkeypatch, spark, many)
    assert kept == stay(list(enumerate(many)))[0]
    assert large < 8 * max(small, 500) and large < 20_000  # 600 texts have 180,000 pairs


def test_prefix_filter_loses_no_pair(spark):
    """All similar pairs share a shingle of the longer's prefix and the shorter's early one, whatever is called common."""
    texts = [t for t in families(9)[:210] if t]
    sets = {k: near_dedup.shingle_set(t) for k, t in enumerate(texts)}
    df = spark.createDataFrame([(k, x.view("i8").tolist()) for k, x in sets.items()], "node long, hashes array<long>")
    for common in (near_dedup.common_shingles(df), near_dedup.common_shingles(df.limit(0))):
        look, offer = {}, {}
        for r in near_dedup.prefixes(df, common).collect():
            look.setdefault(r.node, {})[r.hash] = r.rest
            if r.early:
                offer.setdefault(r.node, {})[r.hash] = r.rest
        for a in sets:
            for b in sets:
                if (len(sets[b]), b) < (len(sets[a]), a) and similarity(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8:
                    assert any(9 * min(look[a][h], offer[b][h]) >= 4 * (len(sets[a]) + len(sets[b])) for h in look[a].keys() & offer[b].keys())


def test_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(120_000))
    docs = spark.createDataFrame([(5, long), (3, long + " end"), (4, "short text of a few words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [3, 4]
