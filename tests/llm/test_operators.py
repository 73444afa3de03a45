"""The text operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardflow.llm import decontaminate, dom_boost, merge_replay, pii, planes, simhash, sketch, suffix_tree, toxicity, url_lists
from wardflow.llm.components import connected_components
from wardflow.session import run_folder

WORDS = "the of and to statement Thnt, ververbe. Über éa naïve x 12 don't 世界 😀".split()
SCHEMA = "doc_id long, text string, lang string, fp long, id long, ids binary, key string, h long"


def some_texts(n=40, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += ["", None, " ", "\n\t ", "a", "  two  spaces ", "line\nends\n\nhere \n", "x" * 5000, "the of " * 4000, texts[0], texts[1]]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    """Texts under ids with gaps, an id twice (one row repeated, one with another text) and clashing column names."""
    texts = some_texts()
    rows = [(3 * i - 7, t, "en", 1, 2, b"", "k", 5) for i, t in enumerate(texts)]
    rows += [rows[4], (rows[5][0], "another text of the same id", *rows[5][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# --- 1 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000, planes.BLOCK, planes.BLOCK + 3):
        ids = rng.integers(0, 2**32 if n < 100 else 50257, n, dtype=np.uint32)
        lengths, data = planes.pack(ids, kind)
        assert sum(lengths) == len(data)
        assert np.array_equal(planes.unpack(n, lengths, data, kind), ids)


def test_plane_files(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = run_folder(spark, "planes-test")
    planes.write(docs, path, vocabulary)
    got = sorted(map(tuple, planes.read(spark, path).collect()), key=lambda r: r[1])
    plain, start = Tokenizer.from_file(vocabulary), 0
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, Counter())[np.array([*plain.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()] += 1
    seen = {}
    for doc_id, at, n, ids in got:
        assert at == start and n == len(ids) // 4
        start += n
        seen.setdefault(doc_id, Counter())[bytes(ids)] += 1
    assert [r[0] for r in got] == [r[0] for r in rows] and seen == want
    empty = run_folder(spark, "planes-test")
    planes.write(nothing, empty, vocabulary)
    assert planes.read(spark, empty).count() == 0


# --- 2 -------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_components(docs, rows, nothing):
    found = simhash.near_duplicates(docs).collect()
    prints = Counter((r.id, r.fp % 2**64) for r in found)
    assert prints == Counter((i, plain_fingerprint(t)) for i, t in rows)
    distinct = sorted({p for _, p in prints})
    root = components(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        least[root[p]] = min(i, least.get(root[p], i))
    assert all(r.component_id == least[root[r.fp % 2**64]] for r in found)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_vantage_tree_loses_no_link(bits):
    rng = np.random.default_rng(bits)
    flip = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 900)).astype(np.uint64), axis=0)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 1500).astype(np.uint64), np.uint64(77) ^ flip(1), np.uint64(2**60) ^ flip(4)]))
    tree = simhash.VantageTree(x[::5], 8, bits)
    edges = [e for _, some in tree.place(x) for e in zip(*map(np.ndarray.tolist, simhash.shard_forest(some, bits, block=100)), strict=True)]
    assert tree.leaves > 2 and all((a ^ b).bit_count() <= 64 for a, b in edges)
    parent = {k: k for k in x.tolist()}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    labels = np.array([find(k) for k in x.tolist()], dtype=np.uint64)
    assert not (near & (labels[:, None] != labels[None, :])).any()
    whole, roots = simhash.exact_forest(x, bits)
    truth = dict(zip(whole.tolist(), roots.tolist(), strict=True))
    same = {}
    for k in x.tolist():
        same.setdefault(truth.get(k, k), set()).add(find(k))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(labels.tolist()))


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges if e[0] != e[1]}
    nodes = sorted({n for e in linked for n in e})
    assert got == components(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3 -------------------------------------------------------------------------------------


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(4)
    for alphabet, n in (("ab.@-+ 0123459()%é\n", 12000), ("0123456789 -.", 6000)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(text) == plain_spans(text)


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Hello email: user{i}@mail.example.com and version: 2 of it", "x") for i in range(6)]
    rows += [(10, "write to Email: john.doe9[at]site thanks", "x"), (11, None, "x"), (12, "", "x"), (13, "call +1 (212) 555-0199 now", "x"), (14, "email: none", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    found = {r.id: r for r in pii.extract(docs).collect()}
    assert pii.extract(docs).count() == len(rows)
    assert [tuple(s) for s in found[10].added] == [("email", 16, 25)] and not any(found[i].added for i in found if i != 10)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[10] == "write to Email: [EMAIL][at]site thanks" and masked[11] is None and masked[12] == "" and masked[13] == "call [PHONE] now"
    assert pii.mask(docs).columns == docs.columns and pii.extract(docs.limit(0)).count() == 0


# --- 4 -------------------------------------------------------------------------------------


def plain_shingles(text, width=5):
    words = [""] * (width - 1) + [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_sketches(spark):
    rng = random.Random(5)
    a = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n)) for n in (1, 3, 20, 50, 400, 900)]
    b = [t[: len(t) * 3 // 4] + " zz" for t in a]
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(90, "", ""), (91, " \n", "a"), (92, a[2], a[2])]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string").select("*", sketch.bottom_k(F.col("a")).alias("x"), sketch.bottom_k(F.col("b")).alias("y"))
    df = df.select("*", sketch.resemblance(F.col("x"), F.col("y")).alias("r"), sketch.containment(F.col("x"), F.col("y")).alias("c"), sketch.distinct_count(F.col("x")).alias("n"), sketch.bottom_k(F.concat_ws(" ", "a")).alias("z"))
    for r in df.collect():
        p, q = plain_shingles(r.a), plain_shingles(r.b)
        true = len(p & q) / len(p | q) if p | q else 1.0
        assert r.x == sorted(set(r.x)) and r.x == r.z and len(r.x) == min(len(p), sketch.K)
        assert abs(r.r - true) <= (0.2 if len(p | q) > sketch.K else 1e-9)
        assert abs(r.n - len(p)) <= (0.4 * len(p) if len(p) >= sketch.K else 1e-9)
        assert abs(r.c - (len(p & q) / len(p) if p else 1.0)) <= (0.3 if len(p | q) > sketch.K else 1e-6)


def test_sketches_merge_in_any_order(spark):
    parts = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n o"), (1, "a b c d e f g"), (2, "x")], "g int, text string").select("g", sketch.bottom_k(F.col("text"), k=6).alias("sketch"))
    merged = {r.g: r.sketch for r in sketch.merge_group(parts, ["g"], k=6).collect()}
    everything = sorted({h for r in parts.collect() if r.g == 1 for h in r.sketch})[:6]
    assert merged[1] == everything and len(merged[2]) == 1


@pytest.mark.parametrize("target", [3, 1000])
def test_next_document(docs, rows, nothing, target):
    frame = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    got = sorted((r.id, r.text, r.next.text) for r in sketch.with_next(frame, target_rows=target).collect())
    assert got == sorted((i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows))
    assert sketch.with_next(nothing.select("id", "text")).count() == 0


# --- 5 -------------------------------------------------------------------------------------


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(300):
        item, text = ("".join(rng.choice("abc ") for _ in range(n)) for n in (rng.randint(1, 90), rng.randint(0, 120)))
        assert decontaminate.best_distance(item, text, 1000)[0] == plain_distance(item, text)


def test_contamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, "  "), (52, "ab")]
    texts = []
    for i in range(60):
        body = " ".join(word() for _ in range(40))
        if i % 3:
            item = list(items[i % 12][1])
            for _ in range(i % 7):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "qq"[:1]])
            body = body[:50] + " " + "".join(item).upper() + "\n" + body[50:]
        texts.append(body)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (1, texts[1], 1)], "doc_id long, text string, edits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.id, r.item_id, r.edits) for r in decontaminate.contamination(docs, bench).collect())
    want = Counter()
    for r in docs.collect():
        for name, item in items:
            form, text = decontaminate.normal(item or ""), decontaminate.normal(r.text or "")
            if form and text and (d := plain_distance(form, text)) <= int(decontaminate.RATE * len(form)):
                want[r.doc_id, name, d] += 1
    assert got == want and len(want) > 20
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {k[0] for k in want}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and decontaminate.clean_documents(docs, bench.limit(0)).count() == docs.count()


# --- 6 -------------------------------------------------------------------------------------


def test_merge_replay(spark, docs, rows, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    alphabet = "aabbcde  \n\t'sé世ａ😀123!!..,́\x1c\x85 　xyz"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 3000, " " * 50, "ab" * 2000, "it's they'll  x", "\n\n a", "."]
    own = merge_replay.encoder(path)
    encoded = own.encode(texts)
    assert [plain.encode_ordinary(t) for t in texts] == [np.frombuffer(x, "<u4").tolist() for x in encoded]
    assert [own.decode(x).decode() for x in encoded] == texts
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in merge_replay.digest_documents(docs, path).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == Counter((i, len(x), sha(np.array(x, dtype="<u4").tobytes()), sha(t.encode())) for i, t in rows for x in [plain.encode_ordinary(t)])
    assert merge_replay.encode_rows(docs, path).columns == [c for c in docs.columns if c != "ids"] + ["n_tokens", "ids", "decoded"]
    assert merge_replay.digest_documents(nothing, path).count() == 0


def test_words_with_falling_ranks_are_done_again():
    """A vocabulary in which a merge makes a pair of lower rank than itself."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"abcbc": 310, b"cbc": 270}
    own = merge_replay.MergeReplay(ranks, r"\S+|\s+")
    words = ["".join(p) for p in ("abcbc", "bcbc", "abc", "aabcbcbc", "cbcabc")]
    for w in words:
        assert own.words([w])[0] == np.array([ranks[w.encode()]] if w.encode() in ranks else own.one_by_one(w.encode()), dtype="<u4").tobytes()


# --- 7 -------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(8)
    syllables = "an er in th re on ti es or te of ed is it al ar st to nt".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words, bad = [word() for _ in range(rng.randint(20, 80))], i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumblefuzz", "zwicky", "blockhead"])
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(bad), 1))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "x" * 20000, 1.0), (1003, " ".join([word() for _ in range(30)] + ["z-w-i-c-k-y", "blockkhead"]), 1.0), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([*labels, (5, None, 1), (6, 1, 1), (7777, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs, labels.select("doc_id", "toxic"))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([(r.doc_id % 6 == 0) == r.predicted for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score < 0.5 and by_id[1002].predicted == 0 and by_id[1003].predicted == 1
    kept = toxicity.harmless(docs, model)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.predicted)
    none = toxicity.learn(docs, labels.select("doc_id", "toxic").limit(0))
    assert all(r.predicted == 0 for r in toxicity.score_documents(docs, none).collect())


def test_kernel_tolerates_gaps():
    marks = toxicity.Landmarks(["idiot", "banana"])
    kernel = lambda w: marks.features([w]) @ np.linalg.inv(marks.whiten)
    plain, gapped, other = (kernel(w)[0, 0] for w in ("idiot", "id-iot", "window"))
    assert plain > gapped > 10 * max(other, 1e-12)


# --- 8 -------------------------------------------------------------------------------------


def test_language_model(spark, docs, rows, nothing):
    got = suffix_tree.score_documents(docs).collect()
    tokens = lambda t: t.encode().lower().split() + [b""]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        own = tokens(t)
        want[i, zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert suffix_tree.score_documents(nothing).count() == 0


def test_tree_distributions_sum_to_one():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 6, 400) if i % 2 else np.tile([1, 2, 3, 4], 90) for i in range(12)]
    grams, n = suffix_tree.count_grams(texts, np.arange(7), np.arange(7))
    context = grams >> suffix_tree.BITS
    totals = {int(c): (int(n[context == c].sum()), int((context == c).sum())) for c in np.unique(context)}
    root = {s: (1 + sum((t == s).sum() for t in texts)) for s in range(1, 7)}
    root = {s: v / sum(root.values()) for s, v in root.items()}
    kept = n >= 3
    tree = suffix_tree.SuffixTree(root, grams[kept], n[kept], totals)
    assert len(tree.contexts) > 3
    for c in [*map(int, np.unique(context)), 5 << suffix_tree.BITS | 5, suffix_tree.BEGIN]:
        c = c if c >> suffix_tree.BITS else 9 << suffix_tree.BITS | c  # one symbol after another that is in no context
        symbols = np.arange(1, 7)
        p = 10 ** tree.gain(np.full(6, c), symbols) * np.array([root[s] for s in range(1, 7)])
        assert abs(p.sum() - 1) < 1e-9


# --- 9 -------------------------------------------------------------------------------------


def test_main_texts(spark):
    model = dom_boost.train([])
    page = (
        '<html><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad"><p>Buy now, please.</p></div><article><h1>A title</h1><p>One &amp; two<br>\n three.'
        '<p>Some <b>bold</b> words that go on for a while, as they do.</p><script>var t="</p>";</script><!-- x --><form><p>Your mail</p></form></article>'
        '<section class="comments"><p>I disagree with all of it.</p></section><footer>&copy; us</footer></body></html>'
    )
    assert dom_boost.main_texts([page], model) == ["A title\n\nOne & two three.\n\nSome bold words that go on for a while, as they do."]
    odd = ["", "<", "&amp", "<p", "</p></div>", "<div>" * 4000 + "deep", "<article><p>cut he", "<!-- open", "<script>x"]
    assert len(dom_boost.main_texts(odd, model)) == len(odd) and dom_boost.main_texts([], model) == []
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (1, "u", page, "t"), (3, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, dom_boost.extract(pages, dom_boost.learn(pages)).select("page_id", "n_chars").collect()))
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1] == 0
    assert dom_boost.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("piece", [
    "<svg/>", "<svg viewBox='0 0 1 1' />", "<button>Share", "<iframe src=x>", "<select><option>a", "<object data=x>", "<object data=x/>", "<BUTTON type=b>Share", "<button><div>Share</div></button>",
    "<svg><title>icon</title></svg>", "<iframe src=x></iframe>", "<noscript><p>Switch it on.</p></noscript>", "<template><div><p>hidden</p></div></template>", "<button>one<button>two</button>",
])
def test_silent_elements_do_not_swallow_the_page(piece):
    model = dom_boost.train([])
    words = "Some plain words that go on for a while, as the words of an article do. " * 3
    for before, after in (("<p>", ""), ("", "<p>")):
        page = f"<html><head><title>T</title><body><nav><ul><li><a href=/a>Menu</a></ul></nav><article>{before}{piece}{after}{words if before else ''}</p><p>{words}</p><p>{words}</p></article><footer>us</footer></html>"
        blocks = [" ".join(b.split()) for b in dom_boost.main_texts([page], model)[0].split("\n\n")]
        want = [words.strip()] * 2
        assert blocks[-2:] == want and not any("Share" in b or "hidden" in b or "icon" in b or "Menu" in b or b == "T" for b in blocks[-2:])


def test_heads_and_ends():
    model = dom_boost.train([])
    words = "Some plain words that go on for a while, as the words of an article do. " * 3
    for head in ("<head><title>A page</title>", "<head><title>A page</title></head>", "<HEAD><meta charset=x><body>", "<head><script>var a = '<p>';</script><body class=x>"):
        assert dom_boost.main_texts([f"<html>{head}<article><p>{words}<p>{words}</article>"], model) == ["\n\n".join([words.strip()] * 2)]
    texts = lambda source: [t for _, t, _ in dom_boost.Page(source).blocks]
    assert texts("<p>one < two") == ["one < two"] and texts("<p>so <") == ["so <"] and texts("<p>cut <a hre") == ["cut"] and texts("<p>a<textarea>b<p>c") == ["a"]
    assert texts("<p>a <button>b</p><p>c</p>") == ["a", "c"] and texts("<div>a<button><div>b</div>c</button>d</div>e") == ["a d", "e"]


def test_unseen_pages_and_consistent_paths(spark):
    model = dom_boost.train(dom_boost.skeletons(80))
    pages = [dom_boost.Page(v) for v in dom_boost.variants(dom_boost.skeletons(30, seed=8), seed=77)]
    odds, at, right, whole = model.log_odds(dom_boost.features(pages)), 0, 0, 0
    for page in pages:
        state = dom_boost.decode(page, odds[at : at + len(page.group)])
        at += len(page.group)
        assert all(state[i] in dom_boost._NEXT[state[page.parent[i]]] for i in range(1, len(state)))
        right += sum(len(t) * ((state[e] == dom_boost.INSIDE) == bool(page.truth[e])) for e, t, _ in page.blocks)
        whole += sum(len(t) for _, t, _ in page.blocks)
    assert right / whole > 0.93


# --- 10 ------------------------------------------------------------------------------------


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [
        ("block", "bad.example", "add", day(5)), ("block", "bad.example", "add", day(7)), ("block", "BAD.example", "remove", day(10)), ("block", "bad.example", "add", day(20)),
        ("allow", "www.bad.example", "add", day(6)), ("block", "www.bad.example", "add", day(6)), ("block", "x.example/ads", "add", day(1)), ("block", "same.example", "add", day(3)), ("block", "same.example", "remove", day(3)),
        (None, "a", "add", day(1)), ("block", None, "add", day(1)), ("block", "a", None, day(1)), ("block", "a", "add", None), ("block", "bad.example", "add", day(5)),
    ]
    captures = [(i, u, day(d)) for i, (u, d) in enumerate([
        ("http://bad.example/p", 4), ("http://bad.example/p", 5), ("https://bad.example:8080/", 9), ("http://bad.example", 10), ("http://u:p@BAD.example./x", 25),
        ("http://www.bad.example/", 6), ("http://a.b.bad.example/", 6), ("http://notbad.example/", 6), ("http://x.example/Ads/1", 2), ("http://x.example/other", 2), ("http://same.example", 9),
        (None, 6), ("nonsense", 6), ("", 6), ("http://bad.example/p", 5),
    ])] + [(99, "http://bad.example/", None)]
    captures = spark.createDataFrame([(*c, "k") for c in captures], "page_id long, url string, d string, key string").select("page_id", "url", F.to_date("d").alias("fetched"), "key")
    listed = spark.createDataFrame(entries, "list string, key string, action string, d string").select("list", "key", "action", F.to_date("d").alias("day"))
    got = {r.page_id: (r.decision, r.matched_key) for r in url_lists.filter_captures(captures, listed).collect()}
    block, none = ("block", "bad.example"), ("unlisted", None)
    assert got == dict(enumerate([none, block, block, none, block, ("allow", "www.bad.example"), block, none, ("block", "x.example/ads"), none, none, none, none, none, block])) | {99: none}
    spans = {(r.list, r.key, str(r.valid_from)[-2:], str(r.valid_to)[-2:] if r.valid_to else None) for r in url_lists.validity_intervals(listed).collect()}
    assert ("block", "bad.example", "05", "10") in spans and ("block", "bad.example", "20", None) in spans and not any(s[1] == "same.example" for s in spans)
    assert url_lists.filter_captures(captures.limit(0), listed).count() == 0 and url_lists.filter_captures(captures, listed.limit(0)).where("decision <> 'unlisted'").count() == 0
