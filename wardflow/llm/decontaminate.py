"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers' bit-parallel distance.

An item of n characters may be hit with up to ``floor(rate * n)`` = k edits. Cut to k + 1 pieces, at least one piece
is left whole by k edits, so the places where a piece occurs exactly are the only candidates. Each is verified in its
window by the distance between the item and the best substring. Both sides are lower-cased and runs of white space
become one space.

Defined results: a null or empty text has no hits; a null or blank item is ignored; items of equal normal form are hit
together; a repeated document row has its own hits; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import filter_rows, id_and_text, slices, table
from wardflow.llm.registry import query

RATE = 0.05
BLOCK_CHARS = 16_000_000  # of items in one pass over the documents


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_distance(item: str, window: str, most: int) -> tuple[int, int]:
    """(fewest edits between ``item`` and a substring of ``window``, its end), by Myers' bit vectors."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        score += bool(up & top) - bool(down & top)
        if score < best:
            best, end = score, j + 1
            if not best:
                break
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
    return (best, end) if best <= most else (most + 1, 0)


class Matcher:
    """All items of one block in an automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        ids = defaultdict(list)
        for item_id, text in items:
            if form := normal(text):
                ids[form].append(item_id)
        self.items = [(form, names, int(rate * len(form))) for form, names in ids.items()]
        places = defaultdict(list)
        for i, (form, _, k) in enumerate(self.items):
            for at, piece in pieces(form, k):
                places[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, fewest edits, places) of every item found in a text."""
        form = normal(text)
        if not form or not self.items:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(form):
            for i, at in where:
                item, _, k = self.items[i]
                begin = last + 1 - length - at
                a, b = max(0, begin - k), min(len(form), begin + len(item) + k)
                if windows[i] and a <= windows[i][-1][2] and begin - windows[i][-1][0] <= 2 * k:  # pieces of one occurrence
                    windows[i][-1][2] = max(b, windows[i][-1][2])
                    windows[i][-1][1] = min(a, windows[i][-1][1])
                else:
                    windows[i].append([begin, a, b])
        out = []
        for i, found in windows.items():
            item, names, k = self.items[i]
            scores = [s for _, a, b in found if (s := best_distance(item, form[a:b], k)[0]) <= k]
            if scores:
                out += [(name, min(scores), len(scores)) for name in names]
        return out


_MATCHERS: dict[int, Matcher] = {}  # the last block's matcher of this worker process


def matcher(block: list[tuple[int, str]], rate: float) -> Matcher:
    key = hash((tuple(block), rate))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(block, rate)
    return _MATCHERS[key]


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size; each block goes to the workers for one pass, so the number of items is free."""
    items = benchmark.where(F.trim(F.coalesce(item_text, F.lit(""))) != "").select(F.col(item_col).cast("long"), F.col(item_text))
    blocks, size = [[]], 0
    for item_id, text in items.toLocalIterator():
        if size + len(text) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, text))
        size += len(text)
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, edits, places) for every document and item that occurs in it within its edits."""
    rows = id_and_text(docs, id_col, text_col)

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = matcher(block, rate).hits
            for batch in batches:
                for some in slices(batch):
                    found = [(d, *h) for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for h in hits(t)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["id", "item_id", "edits", "places"])

        return rows.mapInArrow(find, "id long, item_id long, edits int, places long")

    return reduce(DataFrame.unionByName, map(search, blocks_of(benchmark)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which an item occurs."""
    for block in blocks_of(benchmark):
        docs = filter_rows(docs, text_col, lambda block=block: lambda texts: [not matcher(block, rate).hits(t) for t in texts], _MATCHERS.clear)
    return docs


@query("op5_pigeonhole_edit_matching")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumnRenamed("id", "doc_id")
