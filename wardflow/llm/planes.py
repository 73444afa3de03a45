"""Token ids in plane-shuffled chunks.

A file set has two tables. ``chunks``: one row per chunk of whole documents, its ids cut to blocks of ``BLOCK`` ids; a
block's ids are transposed to planes (one per byte, or one per bit of the little-endian 32-bit id) and every plane is a
zstandard frame. ``index``: for each chunk its part, number, first id's place in the token stream, ids, documents and
the length of every frame, so that a reader finds a range of ids without the data. Parts follow ascending doc_id.

Defined results: a null or empty text is one document of the end id alone; rows of equal doc_id follow by a hash of their text; null
doc_ids come first; an empty table gives an empty file set; other columns are ignored. A document longer than a chunk
makes its chunk longer. An added token's literal in a text becomes that token's id, as in the library's own call.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import id_and_text, slices, table
from wardflow.llm.registry import query
from wardflow.session import run_folder

BLOCK = 65_536
CHUNK = 4 * BLOCK
CHUNK_ROW = "part int, chunk int, first long, n_ids long, plane_kind string, frame_bytes array<int>, data binary, doc_ids array<long>, doc_tokens array<long>"


def to_planes(ids: np.ndarray, kind: str = "byte") -> np.ndarray:
    """ids (uint32) as rows of planes: 4 byte planes, or 32 bit planes packed to bytes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def pack(ids: np.ndarray, kind: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    """(length of every frame, frames in order of block, then plane)."""
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(plane.tobytes()) for at in range(0, len(ids), BLOCK) for plane in to_planes(ids[at : at + BLOCK], kind)]
    return [len(f) for f in frames], b"".join(frames)


def unpack(n: int, frame_bytes: list[int], data: bytes, kind: str = "byte") -> np.ndarray:
    unpress, view, at, out = zstandard.ZstdDecompressor(), memoryview(data), 0, np.empty(n, dtype=np.uint32)
    per_block = 4 if kind == "byte" else 32
    for block, start in enumerate(range(0, n, BLOCK)):
        size, planes = min(BLOCK, n - start), []
        for length in frame_bytes[block * per_block : (block + 1) * per_block]:
            planes.append(np.frombuffer(unpress.decompress(view[at : at + length]), dtype=np.uint8))
            at += length
        out[start : start + size] = from_planes(np.stack(planes), size, kind)
    return out


_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs but the apostrophe, which may begin a word of its own
SLICE = 16_000_000  # bytes of text that are encoded together


class LibraryEncoder:
    """The tokenizers library over distinct pieces of text. ``encode`` cuts texts at spaces and numbers their distinct
    pieces in Arrow, encodes each piece once and lays the ids out in the order of the texts, again in Arrow.

    The byte-level word pattern always starts a new match at a space between two characters that are not white space, so
    such a piece encodes on its own. Most pieces are lines of letters followed by signs: letters, signs and the line's
    end are one match each, which goes to the library's model as it is and is kept from batch to batch until there are ``limit``.
    Other pieces go many to a call, and the bytes of the ids tell where one ends. Texts with white space before a space,
    or with a literal of an added token, go to the library whole.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], dtype=np.int64)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced: dict[str, bytes] = {}  # word without its leading space: ids of the word with it
        self.bare: dict[str, bytes] = {}  # words and signs without a leading space
        units = self.tokenizer.pre_tokenizer.pre_tokenize_str
        parts = ("one", 0, 3), ("\u0120two", 3, 7), (",.", 7, 9), ("\u010a", 9, 10), ("Six", 10, 13), ("\u0120--", 13, 16), ("\u010a", 16, 17), ("10", 17, 19)
        self.direct = units("one two,.\nSix --\n10") == [(unit, (a, b)) for unit, a, b in parts] and self.tokenizer.normalizer is None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes a byte-level vocabulary writes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """One match of the pattern."""
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def sign(self, signs: str) -> bytes:
        ids = self.bare.get(signs)
        return self.keep(self.bare, signs, signs) if ids is None else ids

    def keep(self, known: dict[str, bytes], key: str, word: str) -> bytes:
        ids = self.word(word)
        if len(known) < self.limit:
            known[key] = ids
        return ids

    def line(self, line: str, known: dict[str, bytes], before: str) -> bytes | None:
        """Letters or digits, then signs, with ``before`` in front; None if it is anything else."""
        stem = line.rstrip(_SIGNS)
        ids = known.get(stem or line)
        if ids is None:
            if not line or stem and not (stem.isalpha() or stem.isascii() and stem.isdigit()):
                return None
            ids = self.keep(known, stem or line, before + (stem or line))
        return ids if not stem or len(stem) == len(line) else ids + self.sign(line[len(stem) :])

    def piece(self, piece: str, known: dict[str, bytes], before: str) -> bytes | None:
        """Lines without other white space, none of them empty; None if it is anything else."""
        if not self.direct:
            return None
        if "\n" not in piece:
            return self.line(piece, known, before)
        first, *others = piece.split("\n")
        lines = [self.line(first, known, before), *[self.line(x, self.bare, "") for x in others]]
        return None if None in lines else self.sign("\n").join(lines)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """ids of distinct pieces with a space before each."""
        out = list(map(self.spaced.get, pieces))
        rest = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self.piece(pieces[i], self.spaced, " ")
            if out[i] is None:
                rest.append(i)
        for i, ids in zip(rest, self.together([" " + pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def together(self, pieces: list[str], run: int = 1024) -> list[bytes]:
        """ids of pieces that begin with a space and end with something other than white space."""
        out: list[bytes] = []
        for at in range(0, len(pieces), run):
            some = pieces[at : at + run]
            joined = "".join(some)
            if any(x in joined for x in self.literals):  # one with a space in it may arise between two pieces
                out += map(self.text, some)
                continue
            raw = self.text(joined)
            reach = self.width[np.frombuffer(raw, dtype="<u4")].cumsum()
            ends = np.cumsum([len(p) for p in some] if joined.isascii() else [len(p.encode()) for p in some])
            cut = np.searchsorted(reach, ends) + 1
            if not np.array_equal(reach[cut - 1], ends):
                raise ValueError("an id spans two pieces")
            cut = (4 * cut).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one text after the other; place of each text's first id, and the end)."""
        if not len(texts):
            return np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        for known in (self.spaced, self.bare):
            if len(known) >= self.limit:
                known.clear()
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        first, last = bounds[:-1], bounds[1:] - 1
        index, pieces = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False)
        size, closed = pc.binary_length(coded.dictionary).to_numpy(), pc.binary_length(pc.utf8_rtrim_whitespace(coded.dictionary)).to_numpy()
        empty, open_end = size == 0, (size == 0) | (closed < size)
        del split, coded

        inner = open_end[index]
        ends_open = inner[last] & (last > first)
        inner[first] &= ~empty[index[first]]
        inner[last] = False
        whole = np.logical_or.reduceat(inner, first)
        for literal in self.literals:
            whole |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)

        ids = [b""] * len(pieces) + [b""]  # then what has no space before it, or ends its text with white space
        index[np.repeat(whole, bounds[1:] - first)] = len(pieces)
        for i in range(len(texts)):
            start = index[first[i]]
            index[first[i]] = len(ids)
            if whole[i]:
                ids.append(self.text(texts[i].as_py()))
                continue
            head = pieces[start]
            known = self.piece(head, self.bare, "") if head else b""
            ids.append(self.text(head) if known is None else known)
            if ends_open[i]:
                end = pieces[index[last[i]]]
                index[last[i]] = len(ids)
                ids.append(self.text(" " + end))

        used = np.zeros(len(ids), dtype=bool)
        used[index] = True
        used = np.flatnonzero(used[: len(pieces)])
        for i, known in zip(used.tolist(), self.pieces(pieces[used].tolist()), strict=True):
            ids[i] = known
        laid = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(laid.buffers()[1], dtype=np.int64)[laid.offset : laid.offset + len(laid) + 1]
        data = laid.buffers()[2]
        flat = np.frombuffer(data, dtype="<u4", count=ends[-1] // 4) if data is not None and ends[-1] else np.empty(0, dtype="<u4")
        return flat, ends[bounds] // 4


_ENCODERS: dict[str, LibraryEncoder] = {}  # of this worker process, by vocabulary file


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write the file set at ``path``, parts in ascending id order.

    One shuffle: texts to ranges of ids. Encoding happens after it, since compressed text is smaller than ids.
    """
    spark = docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, LibraryEncoder(vocabulary))
        part, number, first, held, names, sizes = TaskContext.get().partitionId(), 0, 0, [], [], []
        end = np.array([end_id], dtype="<u4")

        def flush() -> pa.RecordBatch:
            nonlocal number, first
            ids = np.concatenate(held)
            lengths, data = pack(ids, kind)
            row = [part], [number], [first], [len(ids)], [kind], [lengths], [data], [names[:]], [sizes[:]]
            number, first = number + 1, first + len(ids)
            held.clear(), names.clear(), sizes.clear()
            types = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
            columns = [c.split()[0] for c in CHUNK_ROW.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], names=columns)

        waiting = 0
        for batch in batches:
            for some in slices(batch, chars=SLICE):
                ids, bounds = encoder.encode(some.column(1))
                bounds = bounds.tolist()
                for doc_id, begin, stop in zip(some.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    held += ids[begin:stop], end
                    names.append(doc_id)
                    sizes.append(stop - begin + 1)
                    waiting += sizes[-1]
                    if waiting >= CHUNK:
                        yield flush()
                        waiting = 0
        if names:
            yield flush()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(chunks, CHUNK_ROW).write.parquet(f"{path}/chunks")
    written = spark.read.schema(CHUNK_ROW).parquet(f"{path}/chunks").select("part", "chunk", "first", "n_ids", "frame_bytes", F.size("doc_ids").alias("n_docs"))
    before, starts = 0, []
    for part, n in sorted(map(tuple, written.groupBy("part").agg(F.sum("n_ids")).collect())):  # one row per part
        starts.append((part, before))
        before += n
    index = written.join(F.broadcast(spark.createDataFrame(starts, "part int, part_start long")), "part")
    index.select("part", "chunk", (F.col("part_start") + F.col("first")).alias("start"), "n_ids", "n_docs", "frame_bytes").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document of a file set, from its index and chunks."""
    parts = spark.read.parquet(f"{path}/index").groupBy("part").agg(F.min("start").alias("part_start"))  # one row per part
    chunks = spark.read.schema(CHUNK_ROW).parquet(f"{path}/chunks").join(F.broadcast(parts), "part").select(
        F.col("part_start") + F.col("first"), "n_ids", "plane_kind", "frame_bytes", "data", "doc_ids", "doc_tokens"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, kind, lengths, data, names, sizes = (batch.column(j)[i].as_py() for j in range(7))
                raw, ends = unpack(n, lengths, data, kind).tobytes(), np.cumsum(sizes)
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return chunks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


@query("op1_plane_shuffled_ids")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = run_folder(spark, "planes")
    write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
