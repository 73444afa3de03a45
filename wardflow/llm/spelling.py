"""Spelling variants: words one edit apart, found in k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by an L1 distance of at most two: exactly
one between lengths L - 1 and L, two within a length. So for every pair of lengths a k-d tree over the longer words is
searched with that radius, and a branch whose box is further away is left out. What a leaf holds within the radius is
verified letter by letter.

Work is dealt by the upper levels of the same trees: a cell of the tree of length L is a shard, every word lives in the
cell that holds its vector and visits the other cells whose boxes its radius reaches (of two cells only the later one,
so each pair is met once). The upper trees are fitted on a sample of ``SAMPLE`` words; cells take ``SHARD`` words or so,
and their number grows with the words. A cell of anagrams, which no box can part, is cut by a hash of the word, and
visitors go to all its parts.

A form is the near word of the largest count if that is at least twice the word's own, so forms lead upwards and never
in circles; roots are found by pointer jumping, in as many rounds as the logarithm of the longest chain.

Defined results: a null or empty text has no words; a null id counts as empty text in the hash; repeated rows count
again; equal counts are ordered by code points; an empty table has no words; other columns are ignored. A word may be
of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import slices, table, written
from wardflow.llm.registry import query

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
SHARD, LEAF, SAMPLE = 12_000, 48, 100_000
HELD_WORDS = 200_000  # distinct words a task counts before it hands them on
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter runs never become words
_DIMENSION = np.zeros(256, dtype=np.intp)  # a-z, then the letters from U+00C0 on
_DIMENSION[97:123], _DIMENSION[0xC0:] = np.arange(26), np.arange(26, 90)
RESIDENT, VISITOR, SHORTER = 0, 1, 2
NEAR_ROW = "word string, n_near long, best struct<less:long,form:string>"


# --- words ---------------------------------------------------------------------------------


def words_of(doc_id: object, text: str) -> Counter[str]:
    """Words of a text with their counts; where 97 divides the hash of id and run, the run loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[str] = Counter()
    for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more in all texts; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for some in slices(batch):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    for word, n in words_of(doc_id, text).items():
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- trees ---------------------------------------------------------------------------------


def letter_rows(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), 90), dtype=np.int32)
    rows = np.arange(len(letters))
    for column in letters.T:
        out[rows, _DIMENSION[column]] += 1
    return out


@dataclass
class Node:
    """A split at ``counts[dim] <= cut``, or a leaf with its number and the rows it was fitted on."""

    dim: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    leaf: int = -1
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, np.intp))


def build(counts: np.ndarray, size: int) -> tuple[Node, list[Node]]:
    """K-d tree whose leaves hold at most ``size`` rows, or rows of one vector; every split is the most even one."""
    leaves: list[Node] = []

    def grow(rows: np.ndarray) -> Node:
        own = counts[rows]
        best = (0, -1, 0)
        if len(rows) > size:
            for cut in range(int(own.max(initial=0))):
                below = (own <= cut).sum(axis=0)
                even = np.minimum(below, len(rows) - below)
                dim = int(even.argmax())
                best = max(best, (int(even[dim]), dim, cut))
                if 2 * best[0] > 0.8 * len(rows):
                    break
        even, dim, cut = best
        if not even:
            leaf = Node(leaf=len(leaves), rows=rows)
            leaves.append(leaf)
            return leaf
        below = own[:, dim] <= cut
        return Node(dim=dim, cut=cut, low=grow(rows[below]), high=grow(rows[~below]))

    return grow(np.arange(len(counts))), leaves


def reach(root: Node, counts: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, rows of ``counts`` whose L1 distance to the leaf's box is at most ``radius``)."""
    low, high = [0] * 90, [1 << 30] * 90

    def visit(node: Node, rows: np.ndarray, away: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
        if node.low is None:
            yield node, rows
            return
        value, a, b = counts[rows, node.dim], low[node.dim], high[node.dim]
        before = away - np.maximum(np.maximum(a - value, value - b), 0)
        for child, lowest, highest in ((node.low, a, node.cut), (node.high, node.cut + 1, b)):
            new = before + np.maximum(np.maximum(lowest - value, value - highest), 0)
            near = new <= radius
            if near.any():
                low[node.dim], high[node.dim] = lowest, highest
                yield from visit(child, rows[near], new[near])
        low[node.dim], high[node.dim] = a, b

    if len(counts):
        yield from visit(root, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))


# --- shards --------------------------------------------------------------------------------


@dataclass
class Cells:
    """The upper tree of one length; ``parts`` of each leaf."""

    root: Node
    parts: list[int]


def plan_cells(sample: list[str], share: float, shard: int = SHARD) -> dict[int, Cells]:
    """Upper trees by length from a sample that holds one of ``share`` words; a length of one shard has none."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for length, words in by_length.items():
        if len(words) * share > shard:
            root, leaves = build(letter_counts(letter_rows(sorted(words))), max(1, int(shard / share)))
            out[length] = Cells(root, [max(1, round(len(leaf.rows) * share / shard)) for leaf in leaves])
            for leaf in leaves:
                leaf.rows = leaf.rows[:0]
    return out


def deal(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(length, cell, part, role, word, n): every word at home and wherever its radius reaches."""

    def places(own: list[str], length: int, radius: int) -> tuple[np.ndarray, ...]:
        """(row, cell, part) for all parts of the cells of the tree of ``length`` within ``radius``."""
        plan = cells.get(length)
        if plan is None:
            zero = np.zeros(len(own), dtype=np.int64)
            return np.arange(len(own)), zero, zero
        counts, rows, cell, part = letter_counts(letter_rows(own)), [], [], []
        for leaf, some in reach(plan.root, counts, radius):
            n = plan.parts[leaf.leaf]
            rows.append(np.repeat(some, n))
            cell.append(np.full(len(some) * n, leaf.leaf))
            part.append(np.tile(np.arange(n), len(some)))
        return np.concatenate(rows), np.concatenate(cell), np.concatenate(part)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                some = batch.slice(at, 20_000)
                by_length: dict[int, list[int]] = {}
                listed, n = some.column(0).to_pylist(), some.column(1).to_numpy()
                for i, w in enumerate(listed):
                    by_length.setdefault(len(w), []).append(i)
                for length, index in by_length.items():
                    own, index = [listed[i] for i in index], np.array(index)
                    home, home_cell, home_part = places(own, length, 0)
                    mine = np.array([zlib.crc32(w.encode("latin-1")) for w in own])
                    if length in cells:
                        parts = np.array(cells[length].parts)
                        at_home = home_part == mine[home] % parts[home_cell]
                        home, home_cell, home_part = home[at_home], home_cell[at_home], home_part[at_home]
                    order = np.argsort(home)
                    cell_of, part_of = home_cell[order], home_part[order]
                    row, cell, part = places(own, length, 2)
                    later = (cell > cell_of[row]) | (cell == cell_of[row]) & (part > part_of[row])
                    short, short_cell, short_part = places(own, length + 1, 1)
                    for role, r, c, p, to in ((RESIDENT, home, home_cell, home_part, length), (VISITOR, row[later], cell[later], part[later], length), (SHORTER, short, short_cell, short_part, length + 1)):
                        if len(r):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(r), to, dtype=np.int32)), pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(np.full(len(r), role, dtype=np.int32)),
                                pa.array([own[i] for i in r.tolist()]), pa.array(n[index[r]].astype(np.int64)),
                            ], names=["length", "cell", "part", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(spread, "length int, cell int, part int, role int, word string, n long")


def signatures(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bits set from below, four for each of a-z and three for each of eight classes of the other letters; two
    words differ in no more bits than the L1 distance of their counts."""
    capped = np.minimum(counts[:, :26], 4).astype(np.uint64)
    classes = np.minimum(counts[:, 26:].reshape(len(counts), 8, 8).sum(axis=2), 3).astype(np.uint64)
    ones = lambda n: (np.uint64(1) << n) - np.uint64(1)
    a, b = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint64)
    for i in range(16):
        a |= ones(capped[:, i]) << np.uint64(4 * i)
    for i in range(10):
        b |= ones(capped[:, 16 + i]) << np.uint64(4 * i)
    for i in range(8):
        b |= ones(classes[:, i]) << np.uint64(40 + 3 * i)
    return a, b


def one_replaced(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of letters of one length differ in one place."""
    return (left != right).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of ``long`` is that of ``short`` with one more letter."""
    ahead = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int32).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    return ahead + behind >= short.shape[1]


def near_pairs(root: Node, residents: np.ndarray, queries: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``queries``, rows of ``residents``) one edit apart; with ``own`` the first queries are the residents and
    each of their pairs comes once."""
    longer = residents.shape[1] > queries.shape[1]
    counts = letter_counts(queries)
    (qa, qb), (ra, rb) = signatures(counts), signatures(letter_counts(residents))
    radius, verify = (1, one_inserted) if longer else (2, one_replaced)
    block = max(1, 4_000_000 // LEAF)
    for leaf, reached in reach(root, counts, radius):
        for first in range(0, len(leaf.rows), LEAF):  # a leaf of anagrams may be larger
            rows = leaf.rows[first : first + LEAF]
            for at in range(0, len(reached), block):
                some = reached[at : at + block]
                bits = np.bitwise_count(qa[some, None] ^ ra[None, rows]) + np.bitwise_count(qb[some, None] ^ rb[None, rows])
                i, j = np.nonzero(bits <= radius)
                i, j = some[i], rows[j]
                if own:
                    once = (i >= len(residents)) | (i < j)
                    i, j = i[once], j[once]
                step = max(1, 8_000_000 // residents.shape[1])
                for k in range(0, len(i), step):
                    a, b = i[k : k + step], j[k : k + step]
                    ok = verify(queries[a], residents[b])
                    if ok.any():
                        yield a[ok], b[ok]


def shard_neighbours(words: list[str], n: np.ndarray, role: np.ndarray, length: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words with a near word in the shard, number of them, row of the best one), each pair of the shard counted once.
    Rows must be ordered by role."""
    residents, visitors = int((role == RESIDENT).sum()), int((role == VISITOR).sum())
    if not residents:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    same = letter_rows(words[: residents + visitors])
    root, _ = build(letter_counts(same[:residents]), LEAF)
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    found, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words), dtype=np.int64)

    def note(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            np.add.at(found, x, 1)
            np.minimum.at(best, x, place[y])

    for a, b in near_pairs(root, same[:residents], same, True):
        note(a, b)
    if residents + visitors < len(words) and length > 1:
        for a, b in near_pairs(root, same[:residents], letter_rows(words[residents + visitors :]), False):
            note(a + residents + visitors, b)
    hit = np.flatnonzero(found)
    return [words[i] for i in hit.tolist()], found[hit], order[best[hit]]


def near_words(words: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, form_n, near): number of near words and the one of the largest count; words without one are absent."""
    total = words.count()
    share = max(1, -(-total // sample))
    some = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").collect()] if total > shard else []  # about ``sample`` words at most

    def search(block: pa.Table) -> pa.Table:
        block = block.sort_by("role")
        listed, n = block.column("word").to_pylist(), block.column("n").to_numpy()
        found, near, best = shard_neighbours(listed, n, block.column("role").to_numpy(), block.column("length")[0].as_py())
        pairs = pa.StructArray.from_arrays([pa.array(-n[best], pa.int64()), pa.array([listed[i] for i in best.tolist()], pa.string())], names=["less", "form"])
        return pa.table({"word": pa.array(found, pa.string()), "n_near": pa.array(near, pa.int64()), "best": pairs})

    dealt = deal(words, plan_cells(some, share, shard))
    met = dealt.groupBy("length", "cell", "part").applyInArrow(search, NEAR_ROW)
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("near")
    )


# --- forms and roots -----------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without circles: the last word of each chain, by pointer jumping."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = written(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = written(word_counts(docs, id_col, text_col, least), "words")
    near = near_words(words).withColumnRenamed("word", "of")
    known = words.join(near, F.col("word") == F.col("of"), "left")
    rules = F.col("form_n") >= times * F.col("n")
    forms = written(known.select(
        "word", F.when(rules, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rules, F.col("form_n")).alias("form_n"),
    ), "forms")
    last = roots(forms.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    return forms.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_forms(table(spark, folder, "documents"))
