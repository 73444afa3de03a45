"""Byte-level BPE by replaying merges over all distinct words of a batch at once.

The words' bytes lie in one row of linked symbols. An inverted index leads from a rank to the positions of the pairs
that merge to it. Ranks are taken in ascending order; each merge is applied at all its positions, and only the pairs
left and right of them are looked up again and entered in the index. Words do not touch, so splitting the corpus's
words over tasks and batches gives the ids of one replay over all of them.

A word in which a merge makes a pair of lower rank than itself is done again one merge at a time, leftmost lowest
rank first, which is the definition. A word that is a vocabulary entry as a whole is that entry.

Defined results: a null or empty text has no ids and decodes to nothing; ill-formed code points do not occur in Spark
strings; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wardflow.llm.common import give_back, id_and_text, slices, table
from wardflow.llm.pieces import PieceCache
from wardflow.llm.registry import query

NONE = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encoder of distinct words from a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.octet = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {(ranks[b[:i]] << 32) | ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.cache = PieceCache(self.pieces, lambda t: b"".join(self.words(self.pattern.findall(t))), limit=300_000)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where there is none; negative symbols are ends of words."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        raw = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        sym = self.octet[raw]
        sym[ends] = -1
        n = len(sym)
        word = np.zeros(n, dtype=np.int32)
        word[ends[:-1] + 1] = 1
        word = word.cumsum(dtype=np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n, NONE, dtype=np.int32)
        pair[:-1] = self.rank(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(at: np.ndarray, by: np.ndarray) -> None:
            order = np.argsort(by, kind="stable")
            at, by = at[order], by[order]
            cut = np.flatnonzero(by[1:] != by[:-1]) + 1
            for r, some in zip(by[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(some)

        start = np.flatnonzero(pair != NONE)
        if start.size:
            enter(start, pair[start])
        again: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == r]
            if not at.size:
                continue
            right = nxt[at]
            if at.size > 1 and np.isin(right, at, assume_unique=True).any():  # a pair that overlaps itself: leftmost first
                keep, gone = [], -1
                for p, q in zip(at.tolist(), right.tolist(), strict=True):
                    keep.append(p != gone)
                    gone = q if p != gone else -1
                at = at[keep]
                right = nxt[at]
            after = nxt[right]
            sym[at], sym[right], pair[right] = r, -2, NONE
            nxt[at], prv[after] = after, at
            left = prv[at]
            left = left[left >= 0]
            left = left[sym[left] >= 0]
            touched = np.concatenate((left, at))
            new = self.rank(sym[touched], sym[nxt[touched]])
            pair[touched] = new
            ok = new != NONE
            if ok.any():
                touched, new = touched[ok], new[ok]
                low = new < r
                if low.any():
                    again.update(word[touched[low]].tolist())
                enter(touched, new)
        live = sym >= 0
        sizes = np.bincount(word[live], minlength=len(words))
        ids = sym[live]
        if again:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for w in again:
                parts[w] = np.array(self.one_by_one(words[w]), dtype=np.int32)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, sizes

    def one_by_one(self, word: bytes) -> list[int]:
        """The definition, for one word."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if best == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def words(self, words: list[str]) -> list[bytes]:
        """Bytes of the ids of each word, the words taken as they are."""
        raw = [w.encode() for w in words]
        out = [b""] * len(raw)
        rest = []
        for i, w in enumerate(raw):
            whole = self.ranks.get(w)
            if whole is None:
                rest.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        if rest:
            ids, sizes = self.replay([raw[i] for i in rest])
            packed, cut = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            for i, a, b in zip(rest, [0, *cut[:-1]], cut, strict=True):
                out[i] = packed[a:b]
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        split = [[p] if p.isalpha() or p[:1] == " " and p[1:].isalpha() else self.pattern.findall(p) for p in pieces]
        distinct = list({w for parts in split for w in parts})
        known = dict(zip(distinct, self.words(distinct), strict=True))
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[str, MergeReplay] = {}  # of this worker process, by vocabulary file


def encoder(vocabulary: str) -> MergeReplay:
    if vocabulary not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[vocabulary] = MergeReplay(load_ranks(vocabulary), public_tokenizers.PATTERN)
    return _ENCODERS[vocabulary]


def encode_rows(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with n_tokens, ids (binary) and decoded (string); columns of these names are replaced."""
    docs = docs.drop("n_tokens", "ids", "decoded")
    at = docs.columns.index(text_col)
    names = [*docs.columns, "n_tokens", "ids", "decoded"]
    schema = StructType([*docs.schema.fields]).add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for some in slices(batch, at, chars=2_000_000):
                ids = own.encode([t or "" for t in some.column(at).to_pylist()])
                more = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x).decode() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=names)
        own.cache.spaced.clear()  # a pipeline's next task in this worker is another operator's
        give_back()

    return docs.mapInArrow(encode, schema)


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``encode_documents``'s columns, taken where the ids are, so that they need not leave the worker."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for some in slices(batch):
                ids = own.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    some.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op6_merge_replay")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
