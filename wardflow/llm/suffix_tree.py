"""Language-model scores by a probabilistic suffix tree over words.

A text is its ASCII-lower-cased words and one end token. The root gives a word (c + 1) / (N + V + 1), an unknown one
1 / (N + V + 1). The tree's symbols are the frequent words (at least ``SHARE`` of all tokens), the other known words by
their last two bytes, and the unknown word; within a symbol a word keeps its share at the root. Contexts are the last
one or two symbols. A context stays in the tree if it makes up at least ``CONTEXT`` (``PAIR_CONTEXT`` for each of two
symbols) of all tokens and its next-symbol distribution diverges from that of its suffix by the likelihood-ratio test;
so the tree has at most 1 / CONTEXT + 1 / PAIR_CONTEXT ** 2 contexts, whatever the corpus. A distribution is smoothed
with that of the context's suffix, and a token is scored in the longest kept suffix of its history.

One pass over the texts writes, for every chunk of documents, its distinct words with their training counts and each
document as places in that list. Counts are summed over words and return to the chunks that have the word; there the
documents become symbols, which are counted for the tree and scored with it.

Defined results: a null, empty or blank text is the end token alone; a repeated row counts each time; a null doc_id
counts as the empty id text; with no training rows every count is zero; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import id_and_text, slices, table, written
from wardflow.llm.registry import query

SHARE, CONTEXT, PAIR_CONTEXT, PAIR, TEST, MASS = 1e-4, 5e-4, 2e-3, 1e-6, 12.0, 1.5
UNKNOWN, BEGIN, BITS = 1, (1 << 20) - 1, 20  # symbols are from 1, so that two never look like one
CHUNK_CHARS, CHUNK_WORDS, RUN_TOKENS = 14_000_000, 500_000, 400_000


class Places(dict):
    """Words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def packed(places: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def is_held_out(doc_id: int | None, modulus: int = 7, rest: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (chunk, doc_id, held_out, tokens) and of words (chunk, word, place, n)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "doc_id", "held_out", "tokens", "word", "place", "n"]
        chunk, size, places = TaskContext.get().partitionId() << 32, 0, Places({b"": 0})
        counts = np.zeros(1, dtype=np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            listed = list(places)
            n = np.zeros(len(listed), dtype=np.int64)
            n[: len(counts)] = counts
            for at in range(0, len(listed), 50_000):
                some = listed[at : at + 50_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, chunk)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()),
                    pa.array(some, pa.binary()).cast(pa.string()), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array(n[at : at + k]),
                ], names=names)

        for batch in batches:
            for some in slices(batch):
                ids, tokens = some.column(0).to_pylist(), []
                held = [is_held_out(i) for i in ids]
                for text, out in zip(some.column(1).to_pylist(), held, strict=True):
                    own = text.encode().lower().split()
                    at = np.fromiter(map(places.__getitem__, own), dtype=np.int64, count=len(own))
                    at = np.append(at, 0)
                    size += len(text)
                    tokens.append(packed(at))
                    if not out:
                        seen = np.bincount(at, minlength=len(places)) if len(own) > 50_000 else None
                        if len(counts) < len(places):
                            counts = np.concatenate((counts, np.zeros(max(len(places) - len(counts), len(counts)), dtype=np.int64)))
                        if seen is None:
                            np.add.at(counts, at, 1)
                        else:
                            counts[: len(seen)] += seen
                k = some.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, chunk)), some.column(0).cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.binary()),
                    pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                ], names=names)
                if size >= CHUNK_CHARS or len(places) >= CHUNK_WORDS:
                    counts = counts[: len(places)]
                    yield from words()
                    chunk, size, places, counts = chunk + 1, 0, Places({b"": 0}), np.zeros(1, dtype=np.int64)
        if size or len(places) > 1 or counts.any():
            counts = counts[: len(places)]
            yield from words()

    schema = "chunk long, doc_id long, held_out boolean, tokens binary, word string, place int, n long"
    return id_and_text(docs, id_col, text_col).mapInArrow(split, schema)


class Symbols:
    """Symbol of a word: UNKNOWN, then the frequent words, then the others by their last two bytes."""

    def __init__(self, frequent: list[str]):
        self.place = {w: UNKNOWN + 1 + i for i, w in enumerate(sorted(frequent))}

    def of(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        first, get = UNKNOWN + 1 + len(self.place), self.place.get
        out = np.fromiter((get(w) or first + int.from_bytes(w.encode()[-2:], "little") for w in words), dtype=np.int64, count=len(words))
        out[counts == 0] = UNKNOWN
        return out


class SuffixTree:
    """Contexts of one and two symbols with their symbols' gain over the root, in log10.

    ``root``: probability of each symbol. ``grams``: context << BITS | symbol with its count, those of at least PAIR of
    all tokens; ``totals``: count of each context and number of its different symbols. As many counts as there are
    different symbols go to the smoothing, and so does what the missing grams hold.
    """

    def __init__(self, root: dict[int, float], grams: np.ndarray, n: np.ndarray, totals: dict[int, tuple[int, int]]):
        size = max(root, default=0) + 1
        self.root = np.full(size, min(root.values(), default=1.0))
        for symbol, p in root.items():
            self.root[symbol] = p
        order = np.argsort(grams)
        grams, n = grams[order], n[order].astype(np.float64)
        self.contexts, self.weights, self.pairs, self.logs = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)
        for two in (False, True):  # the suffix first
            mine = (grams >> (2 * BITS) > 0) == two
            pair, k = grams[mine], n[mine]
            if not len(pair):
                continue
            names, start = np.unique(pair >> BITS, return_index=True)
            of = np.searchsorted(names, pair >> BITS)
            total, kinds = np.array([totals[c] for c in names.tolist()], dtype=np.float64).T
            extra = MASS * kinds
            mass = extra + total - np.add.reduceat(k, start)
            symbol = pair & BEGIN
            parent = 10.0 ** (self.gain((names & BEGIN)[of], symbol) if two else np.zeros(len(pair))) * self.root[symbol]
            p = (k + mass[of] * parent) / (total + extra)[of]
            keep = np.bincount(of, weights=k * np.log(p / parent), minlength=len(names)) >= TEST
            weights = np.log10(mass / (total + extra))
            self._add(names[keep], weights[keep], pair[keep[of]], np.log10(p / self.root[symbol])[keep[of]])

    def _add(self, names: np.ndarray, weights: np.ndarray, pairs: np.ndarray, logs: np.ndarray) -> None:
        for keys, values, more, plus in (("contexts", "weights", names, weights), ("pairs", "logs", pairs, logs)):
            key = np.concatenate((getattr(self, keys), more))
            order = np.argsort(key)
            setattr(self, keys, key[order])
            setattr(self, values, np.concatenate((getattr(self, values), plus))[order])

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def gain(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the symbol's probability in its longest kept context over that at the root."""
        out, left = np.zeros(len(symbol)), np.arange(len(symbol))
        for cut in (context, context & BEGIN):
            own = cut[left]
            at, kept = self._find(self.contexts, own)
            where, known = self._find(self.pairs, own << BITS | symbol[left])
            known &= kept
            out[left[known]] += self.logs[where[known]]
            miss = kept & ~known
            out[left[miss]] += self.weights[at[miss]]
            left = left[~known]
        return out

    def documents(self, each: list[np.ndarray]) -> list[float]:
        """Gain of every document, taken together in runs of bounded size."""
        out: list[float] = []
        for run in runs(each):
            gains = self.gain(np.concatenate([history(x) for x in run]), np.concatenate(run))
            out += np.add.reduceat(gains, np.cumsum([0, *[len(x) for x in run[:-1]]])).tolist()
        return out


def history(symbols: np.ndarray) -> np.ndarray:
    """The two symbols before each one, the later one low."""
    before = np.concatenate(([BEGIN, BEGIN], symbols))
    return before[:-2] << BITS | before[1:-1]


def runs(each: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The arrays in consecutive runs of about ``RUN_TOKENS`` values; none is empty, none is cut."""
    held, size = [], 0
    for x in each:
        held.append(x)
        size += len(x)
        if size >= RUN_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_grams(each: list[np.ndarray], often: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of documents of symbols, for contexts that may stay in the tree."""
    grams, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for run in runs(each):
        context, own = np.concatenate([history(x) for x in run]), np.concatenate(run)
        one = context & BEGIN
        shorter, longer = np.isin(one, often), np.isin(one, most) & np.isin(context >> BITS, most)
        found, n = np.unique(np.concatenate(((one << BITS | own)[shorter], (context << BITS | own)[longer])), return_counts=True)
        grams.append(found)
        counts.append(n)
    found, of = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(of, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    rows = written(chunked(docs, id_col, text_col), "lm-chunks")
    listed = rows.where("word is not null").select("chunk", "word", "place", "n")
    counts = written(listed.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total, distinct = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    symbols = Symbols([r[0] for r in counts.where((F.col("c") > 0) & (F.col("c") >= SHARE * total)).select("word").collect()])  # at most 1 / SHARE

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(symbols.of(batch.column(0).to_pylist(), c).astype(np.int32))], names=["word", "c", "symbol"])

    named = written(counts.mapInArrow(name, "word string, c long, symbol int"), "symbols")
    by_symbol = {s: int(c) for s, c in named.where("c > 0").groupBy("symbol").agg(F.sum(F.col("c") + 1)).collect()}  # at most 1 / SHARE + 65,537
    root = {s: c / (total + distinct + 1) for s, c in by_symbol.items()} | {UNKNOWN: 1 / (total + distinct + 1)}
    often = np.array([s for s, c in by_symbol.items() if c >= CONTEXT * total] + [BEGIN], dtype=np.int64)
    most = np.array([s for s, c in by_symbol.items() if c >= PAIR_CONTEXT * total] + [BEGIN], dtype=np.int64)
    looked_up = listed.select("chunk", "word", "place").join(named, "word").select("chunk", "place", "c", "symbol")
    texts = rows.where("word is null").select(F.col("chunk").alias("of_chunk"), "doc_id", "held_out", "tokens")
    floor = float(np.log10(total + distinct + 1))

    def look(texts: pa.Table, looked_up: pa.Table) -> pa.Table:
        """Documents as symbols with their root scores, then the gram counts of the training ones."""
        n = looked_up.num_rows
        c, symbol, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), looked_up["place"].to_numpy()
        c[place], symbol[place] = looked_up["c"].to_numpy(), looked_up["symbol"].to_numpy()
        base = np.log10(c + 1.0) - floor
        docs, train = [], []
        for data, out in zip(texts["tokens"].to_pylist(), texts["held_out"].to_pylist(), strict=True):
            at = unpacked(data)
            own = symbol[at]
            docs.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), packed(own)))
            if not out:
                train.append(own)
        grams, count = count_grams(train, often, most)
        k, g = len(docs), len(grams)
        columns = list(zip(*docs, strict=True)) or [()] * 4
        both = lambda values, kind, more: pa.concat_arrays([pa.array(values, kind), more])
        return pa.table({
            "doc_id": both(texts["doc_id"].to_pylist(), pa.int64(), pa.nulls(g, pa.int64())), "held_out": both(texts["held_out"].to_pylist(), pa.bool_(), pa.nulls(g, pa.bool_())),
            "n_tokens": both(columns[0], pa.int64(), pa.nulls(g, pa.int64())), "n_known": both(columns[1], pa.int64(), pa.nulls(g, pa.int64())),
            "base_score": both(columns[2], pa.float64(), pa.nulls(g, pa.float64())), "symbols": both(columns[3], pa.binary(), pa.nulls(g, pa.binary())),
            "gram": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(grams)]), "n": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(count)]),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, symbols binary, gram long, n long"
    seen = written(texts.groupBy("of_chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(look, schema), "lm-symbols")
    grams = written(seen.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    totals = {c: (n, k) for c, n, k in grams.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n"), F.count("*")).collect()}  # one per context
    kept = grams.where(F.col("n") >= PAIR * total).toPandas()  # at most 2 / PAIR
    tree = spark.sparkContext.broadcast(SuffixTree(root, kept["gram"].to_numpy(dtype=np.int64), kept["n"].to_numpy(dtype=np.int64), totals))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = tree.value.documents([unpacked(x).astype(np.int64) for x in batch.column(5).to_pylist()])
            base = batch.column(4)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(4)], pa.array([total] * batch.num_rows, pa.int64()), base, pa.array(np.array(base) + np.array(gains, dtype=np.float64)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = seen.where("gram is null").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "symbols")
    return found.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op8_probabilistic_suffix_tree")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))
