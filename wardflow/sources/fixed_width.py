"""Fixed-width scan and decode: every version in one pass over the lines, all in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.operators.once import once
from wardflow.operators.size import small
from wardflow.session import run_folder
from wardflow.sources.layouts import Block, Family, Field

_ROW_BITS = 33  # low bits of monotonically_increasing_id: the row's place in its partition
_CHECKED = ("N", "D")  # kinds of fields that can be wrong
_PIECE = 32  # characters of a line in which the places of fields are counted


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Non-empty lines with file name and exact line number: (source_file, line_no, line).

    Files may be split over tasks. A line's number is its place in its split plus the number of
    lines in the file's earlier splits. The split sizes, one row per split, are stored first; so
    their size is known, and while it is small the lines themselves are not shuffled.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        place_in_task().alias("row_no"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
    )
    return number_lines(raw).where(F.col("line") != "")


def split_shifts(raw: DataFrame) -> DataFrame:
    """(source_file, split_start, shift), stored: what makes a row's number in its task the number in its file, from 0."""
    sizes = raw.groupBy("source_file", "split_start").agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n_lines")
    )
    in_file = Window.partitionBy("source_file").orderBy("split_start")
    earlier = F.sum("n_lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        "source_file", "split_start",
        (F.coalesce(earlier, F.lit(0)) - F.col("first_row")).alias("shift"),
    )
    spark = raw.sparkSession
    path = run_folder(spark, "splits")
    offsets.write.parquet(path)
    return spark.read.schema(offsets.schema).parquet(path)


def number_lines(raw: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """(source_file, …, line_no, line) from lines (source_file, split_start, row_no, line, …) with their place in a split."""
    shifts = split_shifts(raw) if shifts is None else shifts
    others = [c for c in raw.columns if c not in ("source_file", "split_start", "row_no", "line")]
    bare = F.when(F.col("line").endswith("\r"), F.rtrim(F.col("line"), F.lit("\r"))).otherwise(F.col("line"))
    return once(raw, "line", bare).join(small(shifts), ["source_file", "split_start"]).select(
        "source_file", *others,
        (F.col("row_no") + F.col("shift") + 1).alias("line_no"),
        "line",
    )


def place_in_task() -> Column:
    """A row's place in its task: with the split's first place, its place in the split."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def cast_field(raw: Column, kind: str) -> Column:
    """Typed value: integers as bigint, dates as unchecked ISO text, blank as NULL."""
    clean = F.trim(raw)
    if kind == "N":
        return F.when(clean.rlike("^-?[0-9]+$"), clean.try_cast("bigint"))
    if kind == "D":
        iso = F.concat_ws("-", F.substring(clean, 5, 4), F.substring(clean, 3, 2), F.substring(clean, 1, 2))
        return F.when(clean.rlike("^[0-9]{8}$") & (clean != "00000000"), iso)
    return F.nullif(clean, F.lit(""))


def field_error(name: Column | str, raw: Column, kind: str) -> Column | None:
    """Error text of a slice that does not fit its type, else NULL."""
    clean = F.trim(raw)
    label = F.lit(name) if isinstance(name, str) else name
    if kind == "N":
        bad = (clean != "") & ~clean.rlike("^-?[0-9]+$")
        reason = "not a number"
    elif kind == "D":
        bad = (clean != "") & ~clean.rlike("^0+$") & ~clean.rlike("^[0-9]{8}$")
        reason = "not a DDMMYYYY date"
    else:
        return None
    return F.when(bad, F.concat(label, F.lit(f": {reason} (raw="), raw, F.lit(")")))


def _by_version(family: Family, pick) -> Column | None:
    """``pick(layout)`` by record version, versions with the same result sharing a branch."""
    groups: dict[object, list[str]] = {}
    for layout in family.layouts:
        value = pick(layout)
        if value is not None:
            groups.setdefault(value, []).append(layout.version)
    if not groups:
        return None
    version = F.col("record_version")
    branches = list(groups.items())
    if len(branches) == 1 and len(branches[0][1]) == len(family.layouts):
        return branches[0][0]
    out = None
    for value, versions in branches:
        test = version.isin(*versions)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out


def _pieces(family: Family, line: Column) -> dict[str, Column]:
    """Pieces of the fixed part, each as long as the fields that begin in it need.

    Spark counts the characters of a text from its beginning, so many slices far into a line cost more than the rest of
    the decode.
    """
    ends: dict[int, int] = {}
    for layout in family.layouts:
        for f in layout.fields:
            k = (f.start - 1) // _PIECE
            ends[k] = max(ends.get(k, 0), f.end)
    return {f"_piece_{k}": F.substring(line, k * _PIECE + 1, end - k * _PIECE) for k, end in ends.items()}


def _raw_field(family: Family, name: str) -> Column:
    """Slice of a fixed field whatever the version, from the pieces of the line; only moved fields need a case."""
    def cut(start: int, width: int) -> Column:
        k = (start - 1) // _PIECE
        return F.substring(f"_piece_{k}", start - k * _PIECE, width)

    spans: dict[tuple[int, int], list[str]] = {}
    for layout in family.layouts:
        f = layout.field(name)
        if f is not None:
            spans.setdefault((f.start, f.width), []).append(layout.version)
    everywhere = sum(len(v) for v in spans.values()) == len(family.layouts)
    if len(spans) == 1 and everywhere:
        (start, width), = spans
        return cut(start, width)
    out = None
    for (start, width), versions in spans.items():
        test = F.col("record_version").isin(*versions)
        piece = cut(start, width)
        out = F.when(test, piece) if out is None else out.when(test, piece)
    return out


def tag_version(lines: DataFrame, family: Family) -> DataFrame:
    """Add the version code and whether a layout knows it."""
    width = family.version_end - family.version_start + 1
    version = F.substring("line", family.version_start, width)
    return lines.withColumn("record_version", version).withColumn(
        "known_version", F.col("record_version").isin(*family.versions)
    )


def decode(lines: DataFrame, family: Family) -> DataFrame:
    """Decode known-version lines: fixed fields, block arrays, lengths and accumulated errors.

    A record is never dropped: what does not fit leaves a NULL, the raw text in ``errors``. Columns ``part_file`` (a
    transmission in several files) and ``file_time`` of the lines are kept. Fields and items are judged one by one only where one expression over
    the fixed part, or over a block's text, does not find all of them right.
    """
    line = F.col("line")
    counters = sorted({b.counter for lay in family.layouts for b in lay.blocks})
    known = tag_version(lines, family).where("known_version").withColumns(_pieces(family, line))
    known = known.withColumns({f"_raw_{c}": _raw_field(family, c) for c in counters})

    fixed, errors = [], []
    for name, kind in family.fields():
        raw = F.col(f"_raw_{name}") if name in counters else _raw_field(family, name)
        fixed.append(cast_field(raw, kind).alias(name))
        error = field_error(name, raw, kind)
        if error is not None:
            errors.append(error)
    base = ["source_file", *[c for c in ("part_file", "file_time") if c in lines.columns], "line_no", "line", "record_version"]
    out = known.select(*base, *fixed, F.when(line.rlike(_clean_lines(family)), _none()).otherwise(F.array_compact(F.array(*errors))).alias("errors"))
    out = out.withColumns({f"_{name}_n": _block_count(family, name) for name, _ in family.blocks()})

    texts: dict[str, Column] = {}
    offset: Column = _lit_or_case(family, lambda lay: lay.fixed_length)
    for name, _ in family.blocks():
        n, length = F.col(f"_{name}_n"), F.col(f"_{name}_n") * _block_width(family, name)
        texts[f"_{name}_text"] = F.when(n > 0, F.substring(line, offset + 1, length)).otherwise(F.lit(""))
        offset = offset + length
    out = out.withColumns({**texts, "expected_length": offset, "actual_length": F.length(line)})

    blocks: dict[str, Column] = {}
    block_errors: list[Column] = []
    for name, fields in family.blocks():
        blocks[name], item_errors = _decode_block(family, name, fields)
        block_errors.append(item_errors)
    length_error = F.when(
        F.col("actual_length") != F.col("expected_length"),
        F.format_string("record length: expected %d, found %d", "expected_length", "actual_length"),
    )
    negative = [
        F.when(F.col(c) < 0, F.format_string(f"counter {c} is negative (%d)", F.col(c)))
        for c in counters
    ]
    every = F.concat("errors", *block_errors, F.array_compact(F.array(*negative, length_error)))
    names = [name for name, _ in family.fields()]
    return out.select(*base, *names, every.alias("errors"), *[c.alias(n) for n, c in blocks.items()], "expected_length", "actual_length")


def _block(layout, name: str) -> Block | None:
    return next((b for b in layout.blocks if b.name == name), None)


def _lit_or_case(family: Family, pick) -> Column:
    value = _by_version(family, pick)
    return value if isinstance(value, Column) else F.lit(value)


def _block_count(family: Family, name: str) -> Column:
    counter = next(b.counter for lay in family.layouts for b in lay.blocks if b.name == name)
    count = F.greatest(F.coalesce(F.col(counter), F.lit(0)), F.lit(0)).cast("int")
    having = [lay.version for lay in family.layouts if _block(lay, name)]
    if len(having) == len(family.layouts):
        return count
    return F.when(F.col("record_version").isin(*having), count).otherwise(F.lit(0))


def _block_width(family: Family, name: str) -> Column:
    return _lit_or_case(family, lambda lay: _block(lay, name).width if _block(lay, name) else 0)


def _decode_block(family: Family, name: str, fields: list[tuple[str, str]]):
    """Array of block items and array of their errors."""
    width, n, whole = _block_width(family, name), F.col(f"_{name}_n"), F.col(f"_{name}_text")
    text = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substring(whole, (i - 1) * width + 1, width),
    )
    texts = F.when(n > 0, text).otherwise(_none())

    def raw_of(item: Column, field_name: str) -> Column:
        spans: dict[tuple[int, int], list[str]] = {}
        for layout in family.layouts:
            block = _block(layout, name)
            f: Field | None = next((x for x in block.fields if x.name == field_name), None) if block else None
            if f is not None:
                spans.setdefault((f.start, f.width), []).append(layout.version)
        having = sum(1 for lay in family.layouts if _block(lay, name))
        if len(spans) == 1 and sum(len(v) for v in spans.values()) == having:
            (start, w), = spans
            return F.substring(item, start, w)
        out = None
        for (start, w), versions in spans.items():
            test = F.col("record_version").isin(*versions)
            piece = F.substring(item, start, w)
            out = F.when(test, piece) if out is None else out.when(test, piece)
        return out

    items = F.transform(
        texts,
        lambda t, i: F.struct(
            (i + 1).alias("seq"), *[cast_field(raw_of(t, f), kind).alias(f) for f, kind in fields]
        ),
    )

    def errors_of(t: Column, i: Column) -> Column:
        found = []
        for f, kind in fields:
            label = F.concat(F.lit(f"{name}["), (i + 1).cast("string"), F.lit(f"].{f}"))
            error = field_error(label, raw_of(t, f), kind)
            if error is not None:
                found.append(error)
        return F.array(*found)

    if not any(kind in _CHECKED for _, kind in fields):
        return items, _none()
    found = F.array_compact(F.flatten(F.transform(texts, errors_of)))
    return items, F.when((n == 0) | _clean_block(family, whole, name), _none()).otherwise(found)


def _right(fields: tuple[Field, ...], fixed: dict[int, str] | None = None) -> tuple[str, int]:
    """Expression of a text whose checked fields are right for certain, and the length it covers; ``fixed`` are texts by place.

    What it does not match may still be right (a number before spaces): it is a reason to look closer, not an error.
    """
    pieces = {at: (re.escape(text), len(text)) for at, text in (fixed or {}).items()}
    for f in fields:
        if f.kind == "N":
            pieces[f.start] = "(?:" + "|".join(f" {{{f.width - k}}}[0-9]{{{k}}}" for k in range(f.width, -1, -1)) + ")", f.width
        elif f.kind == "D":
            pieces[f.start] = f"(?:[0-9]{{8}}| {{{f.width}}})" if f.width == 8 else f" {{{f.width}}}", f.width
    out, end = "", 1
    for at, (piece, width) in sorted(pieces.items()):
        out += f".{{{at - end}}}{piece}"
        end = at + width
    return out, end - 1


def _clean_lines(family: Family) -> str:
    """Expression of the lines, of any version, whose fixed part has no error."""
    return r"(?s)\A(?:" + "|".join(_right(lay.fields, {family.version_start: lay.version})[0] for lay in family.layouts) + ")"


def _clean_block(family: Family, text: Column, name: str) -> Column:
    """Whether a block's text consists of items without an error."""
    patterns: dict[str, list[str]] = {}
    for layout in family.layouts:
        if (block := _block(layout, name)) is not None:
            item, covered = _right(block.fields)
            patterns.setdefault(rf"(?s)\A(?:{item}.{{{block.width - covered}}})*+\z", []).append(layout.version)
    if len(patterns) == 1:
        return text.rlike(next(iter(patterns)))
    out = F.lit(False)
    for pattern, versions in patterns.items():
        out = F.when(F.col("record_version").isin(*versions), text.rlike(pattern)).otherwise(out)
    return out


def _none() -> Column:
    """No error, no item."""
    return F.array().cast("array<string>")


def _part(lines: DataFrame) -> list[str]:
    return [c for c in ("part_file",) if c in lines.columns]


def rejected(lines: DataFrame, family: Family) -> DataFrame:
    """Lines of an unknown version, with the logged message."""
    return tag_version(lines, family).where(~F.col("known_version")).select(
        "source_file", *_part(lines), "line_no",
        F.concat(F.lit("unknown version "), F.col("record_version")).alias("message"),
    )


def record_key(family: Family) -> Column:
    """Surrogate of a record: stable over reloads, built from the natural key."""
    return F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in family.key])


def explode_block(records: DataFrame, name: str, *parent: str) -> DataFrame:
    """One row per block item with the parent columns."""
    return records.select(*parent, F.explode(name).alias("item")).select(*parent, "item.*")


def error_rows(records: DataFrame, lines: DataFrame, family: Family) -> DataFrame:
    """All messages of a load: (format, source_file, part_file if the lines have it, line_no, block, item, ordinal, message).

    Files, line and ordinal (a line's messages in order, from 0) are a message's key; block and item say where in the
    line it arose, NULL for the fixed part and for the line as a whole.
    """
    place = ["source_file", *_part(lines), "line_no"]
    # the outer form: for the inner one Spark filters by the array first, which evaluates it twice
    parsed = records.select(*place, F.posexplode_outer("errors").alias("ordinal", "message")).where("ordinal is not null")
    unknown = rejected(lines, family).select(*place, F.lit(0).alias("ordinal"), "message")
    where = lambda k: F.nullif(F.regexp_extract("message", r"^([a-z0-9_]+)\[([0-9]+)\]", k), F.lit(""))
    return parsed.unionByName(unknown).select(
        F.lit(family.name).alias("format"), *place, where(1).alias("block"), where(2).cast("int").alias("item"), "ordinal", "message"
    )


def render(rows: DataFrame, family: Family, version: str, blocks: dict[str, Column] | None = None) -> DataFrame:
    """The inverse of ``decode``: rows with layout-named text columns become padded lines.

    Missing columns are blank; ``blocks`` gives each repeated block's ready text.
    """
    layout = next(lay for lay in family.layouts if lay.version == version)
    pieces = [_padded(rows, family, f, F.lit(version), len(version)) for f in layout.fields]
    for block in layout.blocks:
        pieces.append((blocks or {}).get(block.name, F.lit("")))
    return rows.withColumn("line", F.concat(*pieces))


def render_versions(rows: DataFrame, family: Family, version: Column, blocks: dict[str, Column]) -> Column:
    """The line of a row in the layout of its own ``version``: only what differs between versions needs a case."""
    def chosen(pieces: dict[str, tuple[object, Column]]) -> Column:
        kinds = {what: piece for what, piece in pieces.values()}
        if len(kinds) == 1 and len(pieces) == len(family.layouts):
            return next(iter(kinds.values()))
        out = None
        for what, piece in kinds.items():
            test = version.isin(*[v for v, (other, _) in pieces.items() if other == what])
            out = F.when(test, piece) if out is None else out.when(test, piece)
        return out.otherwise(F.lit(""))

    width = family.version_end - family.version_start + 1
    out = []
    for name, _kind in family.fields():
        own = {lay.version: lay.field(name) for lay in family.layouts if lay.field(name)}
        out.append(chosen({v: ((f.width, f.kind, f.start if name.startswith("version_format") else 0), _padded(rows, family, f, version, width)) for v, f in own.items()}))
    for name, _fields in family.blocks():
        out.append(chosen({lay.version: (name, blocks[name]) for lay in family.layouts if _block(lay, name)}))
    return F.concat(*out)


def _padded(rows: DataFrame, family: Family, f: Field, version: Column, width: int) -> Column:
    """Text of one field, padded to its width."""
    value = F.col(f.name).cast("string") if f.name in rows.columns else F.lit("")
    if f.name.startswith("version_format") and f.width == width and f.start == family.version_start:
        value = version
    if f.kind == "D":
        value = F.concat(F.substring(value, 9, 2), F.substring(value, 6, 2), F.substring(value, 1, 4))
    text = F.coalesce(value, F.lit(""))
    return F.lpad(text, f.width, "0") if f.kind == "N" else F.rpad(text, f.width, " ")
