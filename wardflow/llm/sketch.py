"""Document fingerprints: the k smallest distinct hashes of a document's word shingles. Built-in functions only.

A shingle is ``width`` (five) words in a row; the start is padded with ``width - 1`` empty words, so a text of one word
has a shingle too and short texts that begin alike share some. A word hash is XXH64 of the word, a shingle hash XXH64
over its word hashes. A sketch is the ascending array of the k smallest distinct shingle hashes: the sketch of a union
is the k smallest of two sketches, so parts of a text or of a corpus merge in any order.

Defined results: a null or wordless text has the empty sketch, fingerprint ''; two empty sketches have resemblance 1,
an empty and another 0. Repeated shingles count once. Equal texts have equal sketches. A repeated doc_id keeps all its
rows; their order is by text. A null doc_id sorts first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.llm.common import table
from wardflow.llm.registry import query

WIDTH = 5
K = 64
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is bound, a repeated expression would run again."""
    return F.get(F.transform(F.array(value), body), 0)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hash of every run of ``width`` word hashes, the start padded; no words, no shingles."""
    pad = F.array_repeat(F.lit(0).cast("long"), width - 1)
    runs = let(F.concat(pad, words), lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
    ))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def bottom_k(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Sketch of a text."""
    return let(word_hashes(text), lambda words: F.slice(F.sort_array(F.array_distinct(shingle_hashes(words, width))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches cover."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_group(sketches: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: hashes are made distinct before the shuffle and only the k smallest of a group leave a task."""
    hashes = sketches.select(*keys, F.explode(sketch).alias("h")).distinct()
    ranked = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all: of the k smallest of the union, those in both."""
    return let(merge(a, b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)
    ))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: common over a's count, from resemblance and the union's count."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def digits(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, target_rows: int = 2000, max_cuts: int = 4096) -> DataFrame:
    """Rows with an ``id`` and other columns, each with a struct ``next`` of the row after it in order of id, then of
    all other columns; the last row is followed by the first.

    Rows go to ranges of ids in one shuffle. A range starts at an id that exists, and the rows of that id go as guests
    to the range before as well, so each range finds its last row's follower without a second pass over the texts.
    The cuts are at most ``max_cuts`` ids; beyond ``max_cuts * target_rows`` rows the ranges grow and their sort spills.
    """
    lowest = -(2**63)
    columns = docs.columns
    docs = docs.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(lowest)))
    n, low = docs.agg(F.count("*"), F.min("key")).first()
    parts = max(1, min(max_cuts, n // target_rows))
    shares = [(i + 1) / parts for i in range(parts - 1)]
    found = docs.select(F.percentile_approx("key", F.array(*map(F.lit, shares)), max(10_000, 20 * parts))).first()[0] if shares else []
    cuts = sorted({lowest if low is None else low, *found})
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks])
    at_most = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("key")))
    placed = docs.withColumn("block", at_most(heads) - 1).withColumn("in_block", at_most(F.get(inner, F.col("block"))))
    placed = placed.withColumn("place", F.col("block") * step + F.col("in_block"))
    starts = F.get(F.get(inner, F.col("block")), F.col("in_block") - 1) == F.col("key")
    guest = F.when(starts, F.when(F.col("place") == 1, F.lit(len(cuts))).otherwise(F.col("place") - 1))
    homes = F.array_compact(F.array(F.struct(F.col("place").alias("p"), F.lit(0).alias("g")), F.when(starts, F.struct(guest.alias("p"), F.lit(1).alias("g")))))
    rows = placed.select(*columns, "key", F.explode(homes).alias("home")).select(*columns, "key", "home.p", "home.g")
    rest = [c for c in columns if c != "id"]
    order = Window.partitionBy("p").orderBy("g", "key", *rest)
    return rows.withColumn("next", F.lead(F.struct(*rest)).over(order)).where("g = 0").select(*columns, "next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by the beginning of ``following``."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - cut), F.left(following, cut))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id_col, sketch) per row."""
    return docs.select(id_col, bottom_k(F.coalesce(F.col(text_col), F.lit("")), k, width).alias("sketch"))


@query("op4_bottom_k_sketch")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("own", bottom_k(F.col("text")))).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    sketched = pairs.select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", bottom_k(F.col("edited")).alias("changed"), F.col("next.own").alias("following"),
    )
    return sketched.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digits(F.col("own")).alias("fingerprint"), digits(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("following")).alias("near_next"),
        containment(F.col("changed"), F.col("own")).alias("edited_in_own"), distinct_count(F.col("own")).alias("n_shingles"),
    )
