"""SimHash near-duplicates through a vantage-point tree over the distinct fingerprints.

A small tree of (vantage point, radius) is made from a bounded sample; it only places fingerprints and decides nothing.
At a node a fingerprint within the radius goes inside, another outside, and one outside by no more than the link
distance goes inside as well. Two linked fingerprints that part at a node then meet inside: if x is inside and y is not,
y's distance to the vantage point exceeds the radius by the link distance at most. So every linked pair meets in a
shard, and all other branches are pruned. A shard goes on the same way down to small blocks, which are compared
exactly, and gives a spanning forest of its links instead of its pairs.

Defined results: a null, empty or wordless text has fingerprint 0 and is linked like any other; a text of fewer words
than a shingle has one shingle; equal fingerprints are linked, so repeated rows are; a null id never names a component
that has another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import id_and_text, slices, table, written
from wardflow.llm.components import connected_components
from wardflow.llm.registry import query

SEED = 42
CELLS = 1_000_000  # distances that are held at once


def text_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every word shingle of an ASCII-lower-cased text, repeats included."""
    import xxhash

    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = zip(*[words[i:] for i in range(width)], strict=False)
    return [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)]


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set if it is in over half of the run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if some.size:
        starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
        octets, ones = hashes.view(np.uint8).reshape(-1, 8), np.empty((some.size, 64), dtype=np.int64)
        for i in range(8):  # a byte of all hashes at a time bounds the unpacked bits
            ones[:, 8 * i : 8 * i + 8] = np.add.reduceat(np.unpackbits(octets[:, i : i + 1], axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                each = [text_hashes(t.encode(), width) for t in some.column(1).to_pylist()]
                counts = np.array([len(h) for h in each], dtype=np.int64)
                fp = fold(np.array([h for hs in each for h in hs], dtype=np.uint64), counts)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(mark, "id long, fp long")


def distances(x: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ point)


class VantageTree:
    """Nodes (vantage point, radius, inside, outside); a negative child is the leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, leaves: int, bits: int):
        self.bits, self.nodes, self.leaves = bits, [], 0
        self.root = self._grow(np.unique(sample), max(1, leaves), np.random.default_rng(7))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves == 1 or x.size < 8:
            return self._leaf()
        best = None
        for point in rng.choice(x, min(12, x.size), replace=False):
            reach = np.bincount(distances(x, point), minlength=65).cumsum()
            for radius in range(64):
                inside, both = reach[radius], reach[min(64, radius + self.bits)] - reach[radius]
                if 0.3 * x.size <= inside <= 0.7 * x.size and (best is None or both < best[0]):
                    best = both, point, radius
        if best is None:
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append(None)
        near = distances(x, best[1]) <= best[2]
        share = max(1, min(leaves - 1, round(leaves * near.mean())))
        self.nodes[at] = best[1], best[2], self._grow(x[near], share, rng), self._grow(x[~near], leaves - share, rng)
        return at

    def place(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, fingerprints that it must see)."""
        todo = [(self.root, x)]
        while todo:
            node, some = todo.pop()
            if not some.size:
                continue
            if node < 0:
                yield -1 - node, some
                continue
            point, radius, inside, outside = self.nodes[node]
            d = distances(some, point)
            todo += [(inside, some[d <= radius + self.bits]), (outside, some[d > radius])]


def exact_forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for every non-root of the components of a block, by exact distances."""
    linked = np.zeros(x.size, dtype=bool)
    step = max(1, CELLS // max(1, x.size))
    for at in range(0, x.size, step):
        linked[at : at + step] = (np.bitwise_count(x[at : at + step, None] ^ x[None, :]) <= bits).sum(axis=1) > 1
    rest, members, roots = x[linked], [], []
    while rest.size:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while frontier.size and rest.size:
            found = np.zeros(rest.size, dtype=bool)
            step = max(1, CELLS // rest.size)
            for at in range(0, frontier.size, step):
                found |= (np.bitwise_count(frontier[at : at + step, None] ^ rest[None, :]) <= bits).any(axis=0)
            frontier, rest = rest[found], rest[~found]
            members.append(frontier)
            roots.append(np.full(frontier.size, root))
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (none, none)


def shard_forest(x: np.ndarray, bits: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The forest of a shard: vantage-point splits down to blocks that are compared exactly."""
    members, roots, todo = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)], [np.unique(x)]
    rng = np.random.default_rng(11)
    while todo:
        some = todo.pop()
        best = None
        if some.size > block:
            for point in rng.choice(some, 4, replace=False):
                d = distances(some, point)
                radius = int(np.median(d)) - bits // 2  # so that the two sides, guests included, are alike
                inside, outside = some[d <= radius + bits], some[d > radius]
                if best is None or inside.size + outside.size < best[0]:
                    best = inside.size + outside.size, inside, outside
        if best is None or max(best[1].size, best[2].size) > 0.9 * some.size:  # small, or too close together to part
            a, b = exact_forest(some, bits)
            members.append(a)
            roots.append(b)
        else:
            todo += [best[1], best[2]]
    return np.concatenate(members), np.concatenate(roots)


def links(distinct: DataFrame, bits: int = 2, per_shard: int = 20_000, max_shards: int = 65_536, sample_per_shard: int = 32) -> DataFrame:
    """A spanning forest (a, b) of all pairs of distinct fingerprints at most ``bits`` apart.

    The sample that shapes the tree has at most ``max_shards * sample_per_shard`` fingerprints (default 2 M, 16 MB).
    """
    n = distinct.count()
    shards = max(1, min(max_shards, -(-n // per_shard)))
    sample = distinct.orderBy(F.xxhash64("fp")).limit(max(1024, shards * sample_per_shard)).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    tree = VantageTree(sample, shards, bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, some in tree.place(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.size, leaf, dtype=np.int32)), pa.array(some.view(np.int64))], names=["shard", "fp"])

    def forest(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_forest(shard["fp"].to_numpy(dtype=np.int64).view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInPandas(forest, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id reachable over links."""
    marked = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = connected_components(links(distinct, bits))
    known = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named = known.join(least, "label").select(F.col("fp").alias("key"), "component_id")
    return marked.join(named, F.col("fp") == F.col("key"), "left").select("id", "fp", "component_id")


@query("op2_vantage_point_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
