"""Personal data by base patterns and by bootstrapped contexts.

One pass over the texts finds the base spans and every place where a cue stands: a word and a delimiter such as
``email:`` or ``phone is``, followed by something that looks like an identifier or not. The rest works on that small
table. Seed entities (base spans) at a cue induce the cue as a pattern; patterns and instances score each other in
turn over their graph, a pattern by the scores of what follows it among all its places, an instance by its best
patterns; patterns that enough distinct seeds support and that keep a high score discover the identifiers at their
other places, of the kind that their seeds have.

Defined results: a null or empty text has no spans; repeated rows have equal spans; added spans never overlap a base
span or each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import id_and_text, slices, table, written
from wardflow.llm.registry import query

KINDS = ["email", "ip", "card", "phone"]
MIN_SEEDS, MIN_SCORE, ROUNDS = 3, 0.6, 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile(r"(?<!\w)(\w{1,40})(?:[ ]?([:=#])[ ]?|[ ](is|at|no)[ ])[\"'(<\[]?(?=\S)")
_IDENTIFIER = re.compile(r"(?=[^\s,;]{0,63}[0-9@])[\w+(][\w.@%+()/-]{4,63}(?<=\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: only the run of local characters before an @ can start one."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def cues(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str | None, str | None, int, int]]:
    """(pattern, instance, kind, start, end) at every cue; kind for a base span there, instance null for plain words."""
    at = {start: (kind, end) for kind, start, end in reversed(spans)}
    taken = sorted((a, b) for _, a, b in spans)
    out = []
    for m in _CUE.finditer(text):
        pattern, start = f"{m[1].lower()} {m[2] or m[3]}", m.end()
        if start in at:
            kind, end = at[start]
            out.append((pattern, text[start:end].lower(), kind, start, end))
            continue
        found = _IDENTIFIER.match(text, start)
        if found and not any(a < found.end() and start < b for a, b in taken):
            out.append((pattern, found[0].lower(), None, start, found.end()))
        else:
            out.append((pattern, None, None, start, start))
    return out


ROW = "id long, mark long, base array<struct<kind:string,a:int,b:int>>, cues array<struct<pattern:string,instance:string,kind:string,a:int,b:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
_CUE_TYPE = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its base spans and cues; ``mark`` tells texts of one id apart."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                spans = [base_spans(t) for t in some.column(1).to_pylist()]
                found = [cues(t, s) for t, s in zip(some.column(1).to_pylist(), spans, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0).cast(pa.int64()), some.column(2),
                    pa.array([[dict(zip(("kind", "a", "b"), s, strict=True)) for s in x] for x in spans], pa.list_(_SPAN)),
                    pa.array([[dict(zip(("pattern", "instance", "kind", "a", "b"), c, strict=True)) for c in x] for x in found], pa.list_(_CUE_TYPE)),
                ], names=["id", "mark", "base", "cues"])

    return id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).mapInArrow(find, ROW)


def patterns(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the cues that stand for a kind of personal data.

    All counts are aggregates with partial sums; the graph holds only cues that some seed follows.
    """
    each = scanned.select(F.explode("cues").alias("c")).select("c.pattern", "c.instance", "c.kind")
    edges = each.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"), F.count_if(F.col("kind").isNotNull()).alias("seeds")).where(F.col("seeds") >= min_seeds)
    graph = written(edges.join(totals, "pattern"), "pattern-graph")
    scores = graph.where("kind is not null").select("instance").distinct().withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        by_pattern = graph.join(scores, "instance", "left").groupBy("pattern").agg(
            (F.sum(F.coalesce("score", F.lit(0.0)) * F.col("n")) / (F.max("total") + 2.0)).alias("p")
        )
        learnt = graph.where("instance is not null").join(by_pattern, "pattern").groupBy("instance").agg(
            F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("seed"), F.max("p").alias("best"), F.countDistinct("pattern").alias("k")
        )
        scores = learnt.select("instance", F.greatest("seed", F.when(F.col("k") > 0, F.col("best") * F.col("best"))).alias("score"))
        scores = written(scores, "instance-scores")
    kinds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    return by_pattern.where(F.col("p") >= min_score).join(kinds, "pattern").select("pattern", "kind", F.col("p").alias("score"))


def added_spans(scanned: DataFrame, learnt: DataFrame) -> DataFrame:
    """(id, mark, added) of the documents in which learnt patterns discover identifiers."""
    places = scanned.select("id", "mark", F.explode("cues").alias("c")).where("c.instance is not null and c.kind is null").select("id", "mark", "c.pattern", "c.a", "c.b").distinct()
    return places.join(learnt.select("pattern", "kind"), "pattern").groupBy("id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("kind", "a", "b"))).alias("added")  # of one document
    )


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, base, added): arrays of (kind, start, end) in code points."""
    scanned = written(scan(docs, id_col, text_col), "pii-scan")
    added = added_spans(scanned, patterns(scanned)).select(F.col("id").alias("i"), F.col("mark").alias("m"), "added")
    joined = scanned.join(added, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    return joined.select("id", "mark", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,a:int,b:int>>")).alias("added"))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span of its text replaced by ``[KIND]``; null texts stay null.

    Base spans are found again where the text is; only documents with discovered spans are met by the join.
    """
    scanned = written(scan(docs, id_col, text_col), "pii-scan")
    added = added_spans(scanned, patterns(scanned)).select(F.col("id").alias("pii_id"), F.col("mark").alias("pii_mark"), F.col("added").alias("pii_added"))
    on = F.col(id_col).eqNullSafe(F.col("pii_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("pii_mark"))
    joined = docs.join(added, on, "left").select(*docs.columns, "pii_added")
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def cover(text: str | None, more: list[dict] | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        spans = base_spans(text) + [(s["kind"], s["a"], s["b"]) for s in more or []]
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b <= end:
                continue
            out += [text[end:a], f"[{kind.upper()}]"] if a >= end else []
            end = b
        return "".join([*out, text[end:]])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, at):
                columns = [some.column(i) for i in range(n)]
                columns[at] = pa.array(map(cover, columns[at].to_pylist(), some.column(n).to_pylist()), columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(masked, docs.schema)


@query("op3_bootstrapped_contexts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [([tuple(s.values()) for s in base], [tuple(s.values()) for s in more]) for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS],
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows]), pa.array([listed(base + more) for base, more in rows]),
                pa.array([len(more) for _, more in rows], pa.int64()),
            ], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_discovered"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_discovered long"
    return found.select("id", "base", "added").mapInArrow(digest, schema)
