"""One row of each group of near-duplicates: exact five-word shingle similarity of at least 0.8, and what it connects.

Rows with the same set of shingles are one node. Candidates are nodes that share a band of MinHash values: with 24 bands
of 6 a pair of similarity 0.8 shares one with probability 0.9993, a pair of 0.3 with 0.017. A candidate pair counts only
after its exact Jaccard similarity, from the shingle sets joined to it. A fingerprint of 64 bits cannot do the search: pairs of
0.8 are up to 18 bits apart, and at that distance a vantage-point split parts nothing.

Not all pairs of a band are made. First all members are compared with one of them; then, in a band of few members, those that
are outside its largest component so far are compared with the members of other components. Pairs within a component change
nothing, so the components are those of all candidate pairs, and a large group of near copies costs about its size.

A large band that is still in parts holds texts that share a long passage without being similar. Its members are paired by
rare shingles instead: with the shingles of every text in one order, the common ones last, two texts of similarity 0.8 share
one among the first fifth of the longer and the first ninth of the shorter, and from their first shared one on both have as
many left as they must share (prefix and position filters, without loss). Texts that differ in more than that beside the
passage are paired with nobody. Again each shingle's texts are first compared with one of them: the one with the fewest
rare shingles, which in a family of edited copies is the text they come from.

Defined results: a null, empty or wordless text has the empty set and is a copy of any other such; a text of fewer than five
words has one shingle; of a group the row of the smallest id stays, a null id last, then the first by the text's MD5;
an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import give_back, slices, written
from wardflow.llm.components import connected_components
from wardflow.llm.simhash import text_hashes

WIDTH, BANDS, ROWS = 5, 24, 6
NUMERATOR, DENOMINATOR = 4, 5  # the similarity from which two texts are near-duplicates
FEW = 30  # members of a band of which all pairs are looked at
COMMON, COMMON_KEPT, BLOCK = 8, 200_000, 2_000_000  # repeats that make a shingle common; the most common so many are told apart (affects work, not results); shingles in one block
_FACTORS = np.random.default_rng(13).integers(0, 2**63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(np.array(text_hashes(text.encode(), WIDTH), dtype=np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band values for each set; the sets are not empty."""
    hashes, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band, factors in enumerate(_FACTORS):
        value = np.full(len(sets), band + 1, dtype=np.uint64)
        for factor in factors:
            value = (value ^ np.minimum.reduceat(hashes * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        out[:, band] = value
    return out


def text_mark(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def marked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, node, n, bands) per row: MD5 of the text, name and size of its shingle set, band values."""
    import xxhash

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                sets = [shingle_set(t) for t in some.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                values = np.zeros((len(sets), BANDS), dtype=np.uint64)
                if sizes.any():
                    values[sizes > 0] = bands([s for s in sets if len(s)])
                at = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(values[sizes > 0].reshape(-1).view(np.int64)))
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(2), pa.array(nodes), pa.array(sizes), listed], names=["id", "mark", "node", "n", "bands"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_mark(text_col).alias("mark"))
    return rows.mapInArrow(mark, "id long, mark string, node long, n int, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) for the nodes of ``wanted`` (node, id, mark)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                sets = [shingle_set(t) for t in some.column(1).to_pylist()]
                at = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), listed], names=["node", "hashes"])
        give_back()

    rows = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_mark(text_col).alias("own_mark"))
    found = rows.join(wanted, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))).select("node", "text")
    return found.mapInArrow(hashes, "node long, hashes array<long>").dropDuplicates(["node"])


def similar(small: Column, large: Column) -> Column:
    """Whether a share of ``small`` in ``large`` is enough."""
    return DENOMINATOR * small.cast("long") >= NUMERATOR * large.cast("long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, exactly."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("a_hashes", "b_hashes")))
    return both.where(similar(F.col("shared"), F.size("a_hashes") + F.size("b_hashes") - F.col("shared"))).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of similar nodes that connect all that candidate pairs connect."""
    posts = nodes.select("node", "n", F.explode("bands").alias("band"))
    several = posts.groupBy("band").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count("*").alias("c")).where("c > 1")
    shared = written(posts.join(several.drop("c"), "band"), "bands")
    sets = written(shingle_sets(docs, nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "best.id", "best.mark"), id_col, text_col), "shingle-sets")
    fits = lambda x, y: similar(F.least(x, y), F.greatest(x, y))
    first = shared.where((F.col("node") != F.col("pivot.node")) & fits(F.col("n"), F.col("pivot.n"))).select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
    found = written(verified(first, sets), "links")
    labels = connected_components(found).withColumnRenamed("node", "of")
    shared = written(shared.join(labels, F.col("node") == F.col("of"), "left").select("band", "node", "n", "pivot", F.coalesce("label", "node").alias("label")), "bands")
    largest = shared.groupBy("band", "label").count().groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    parted = shared.join(largest, "band")
    few = parted.join(parted.groupBy("band").count().where(F.col("count") <= FEW).select("band"), "band")
    minor = few.where("label <> most").select("band", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("label").alias("a_label"))
    other = few.select("band", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("label").alias("b_label"), (F.col("label") == F.col("most")).alias("major"), "pivot")
    needed = (F.col("a_label") != F.col("b_label")) & (F.col("major") | (F.col("a") < F.col("b"))) & fits(F.col("a_n"), F.col("b_n"))
    rest = minor.join(other, "band").where(needed & ~F.col("pivot.node").isin(F.col("a"), F.col("b"))).select("a", "b").distinct()  # the pivot has been compared
    many = parted.groupBy("band").count().where(F.col("count") > FEW).select("band")
    hot = written(parted.join(many, "band").select("node", "n", "label").distinct(), "hot")
    found = written(found.unionByName(verified(rest, sets)), "links")
    return found if hot.isEmpty() else found.unionByName(links_by_rare_shingles(hot, sets, found))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, their column 1 a list, in runs of rows of about ``BLOCK`` list entries."""
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, their counts) of the most common shingles, ``COMMON_KEPT`` at most."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches):
            hashes, counts = np.unique(some.column(1).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[counts > 1]), pa.array(counts[counts > 1].astype(np.int64))], names=["hash", "n"])

    counted = sets.select("node", "hashes").mapInArrow(repeated, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    kept = sorted((r.hash, r.n) for r in counted.orderBy(F.col("n").desc(), "hash").limit(COMMON_KEPT).collect())
    return np.array([h for h, _ in kept], dtype=np.int64), np.array([n for _, n in kept], dtype=np.int64)


def prefixes(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(hash, node, n, rest, early, rare): of every set the shingles that come first in the order of commonness, as many as a longer
    partner must look up; ``early`` those that a shorter partner must offer, ``rest`` the number from the
    shingle on; ``rare`` is the number of the set's shingles that are not common."""
    known, counts = (np.append(x, 0) for x in common)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches):
            hashes, nodes, sizes, rest, early, rare = [], [], [], [], [], []
            for node, own in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                own = own.values.to_numpy()
                at = np.minimum(np.searchsorted(known[:-1], own), len(known) - 1)
                repeats = np.where(known[at] == own, counts[at], 0)
                order = np.lexsort((own, repeats))
                n = len(own)
                look_up = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                offer = n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1
                hashes.append(own[order[:look_up]])
                nodes.append(np.full(look_up, node))
                sizes.append(np.full(look_up, n, dtype=np.int32))
                rest.append(np.arange(n, n - look_up, -1, dtype=np.int32))
                early.append(np.arange(look_up) < offer)
                rare.append(np.full(look_up, (repeats == 0).sum(), dtype=np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, nodes, sizes, rest, early, rare)], names=["hash", "node", "n", "rest", "early", "rare"])

    return sets.where("size(hashes) > 0").select("node", "hashes").mapInArrow(first, "hash long, node long, n int, rest int, early boolean, rare int")


def links_by_rare_shingles(hot: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Further pairs of similar nodes of ``hot`` that connect what is not yet connected by ``found``."""
    own = sets.join(hot.select("node"), "node", "left_semi")
    posts = written(prefixes(own, common_shingles(own)), "prefixes")
    place = lambda x: F.struct(F.col(f"{x}_n"), F.col(x))
    named = lambda df, x: df.select("hash", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "rest", "label")])
    enough = (NUMERATOR + DENOMINATOR) * F.least("a_rest", "b_rest").cast("long") >= NUMERATOR * (F.col("a_n") + F.col("b_n")).cast("long")
    for one in (True, False):
        labels = connected_components(found).withColumnRenamed("node", "of")
        labelled = posts.join(labels, F.col("node") == F.col("of"), "left").select(*posts.columns, F.coalesce("label", "node").alias("label"))
        parts = labelled.groupBy("hash").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("hash")
        labelled = written(labelled.join(parts, "hash"), "prefixes")
        if one:
            pivots = labelled.groupBy("hash").agg(F.min(F.struct("rare", "n", "node", "rest", "label")).alias("p")).select("hash", "p.*")
            needed = similar(F.least("a_n", "b_n"), F.greatest("a_n", "b_n"))
        else:
            pivots, needed = labelled.where("early"), (place("b") < place("a")) & enough
        pairs = named(labelled, "a").join(named(pivots, "b"), "hash").where((F.col("a_label") != F.col("b_label")) & needed).select("a", "b").distinct()
        found = written(found.unionByName(verified(pairs, sets)), "links")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, best) per row; ``best`` has the id and mark of the row that stands for its component."""
    marked = written(marked_rows(docs, id_col, text_col), "marked")
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("best")
    nodes = written(marked.groupBy("node").agg(best, F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    labels = connected_components(links(docs, nodes, id_col, text_col)).withColumnRenamed("node", "of")
    known = nodes.join(labels, F.col("node") == F.col("of"), "left").select("node", "best", F.coalesce("label", "node").alias("label"))
    named = known.join(known.groupBy("label").agg(F.min("best").alias("least")), "label").select(F.col("node").alias("of"), F.col("least").alias("best"))
    return marked.join(named, F.col("node") == F.col("of")).select("id", "mark", "best")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component.

    A row's key is its id and its text's mark, null ids included, so no other row of that id goes with it. Of rows that
    share both, all copies, one stays; only those are numbered.
    """
    found = written(near_duplicates(docs, id_col, text_col), "components")
    keys = found.groupBy("id", "mark").agg(F.first("best").alias("best"), F.count("*").alias("rows"))
    keys = written(keys.withColumn("goes", ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")))), "keys")
    named = lambda x: x.select(F.col("id").alias("key_id"), F.col("mark").alias("key_mark"))
    on = F.col(id_col).eqNullSafe(F.col("key_id")) & (text_mark(text_col) == F.col("key_mark"))
    docs = docs.join(named(keys.where("goes")), on, "left_anti")
    again = named(keys.where("not goes and rows > 1"))
    if again.isEmpty():
        return docs
    order = [F.col(c).cast("string") for c, kind in docs.dtypes if kind in ("int", "bigint", "double", "string", "date", "timestamp", "boolean") and c != text_col]
    nth = F.row_number().over(Window.partitionBy(id_col, text_mark(text_col)).orderBy(*order or [F.lit(0)]))
    first = docs.join(again, on, "left_semi").withColumn("nth_of_key", nth).where("nth_of_key = 1").drop("nth_of_key")
    return docs.join(again, on, "left_anti").unionByName(first)
