"""Delimited sources: self-describing valuation CSV, tariff sheets, pipe and sectioned text files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.operators.size import small
from wardflow.session import run_folder
from wardflow.sources.fixed_width import place_in_task
from wardflow.sources.layouts import TARIFF, VALUATION, CsvColumn

NULL_TOKENS = ("", ".")


def windows_1252(text: Column) -> Column:
    """Characters 0x80-0x9F of a Latin-1 read as their Windows-1252 meaning."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    latin = "".join(chr(c) for c in codes)
    return F.translate(text, latin, bytes(codes).decode("cp1252"))


def null_tokens(text: Column) -> Column:
    """Trimmed text; empty and a lone dot mean missing."""
    clean = F.trim(text)
    return F.when(~clean.isin(*NULL_TOKENS), clean)


def typed(text: Column, kind: str) -> Column:
    return text.try_cast({"I": "bigint", "R": "double"}[kind]) if kind in "IR" else text


def valuation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with their place: (source_file, split_start, row_no, line)."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"), place_in_task().alias("row_no"),
        windows_1252(F.rtrim(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), F.lit("\r"))).alias("line"),
    )


def cells(line: Column) -> Column:
    """The cells of a line, quotes read."""
    raw = F.regexp_extract_all(F.concat(F.lit(";"), line), F.lit(r';("(?:[^"]|"")*"[^;]*|[^;]*)'), F.lit(1))
    bare = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(raw)


def header_maps(headers: DataFrame, columns: tuple[CsvColumn, ...] = VALUATION) -> DataFrame:
    """(header, places, unknown) of distinct header lines: a column's cell number by name, and the cells no column claims.

    The k-th occurrence of a cell in a header goes to the k-th column declaring it.
    """
    owners: dict[str, list[str]] = {}
    for column in columns:
        for alias in column.aliases:
            owners.setdefault(alias, []).append(column.name)
    claims = headers.sparkSession.createDataFrame([(a, k, name) for a, names in owners.items() for k, name in enumerate(names, 1)], "cell string, k int, name string")
    split = headers.select("header").distinct().select("header", F.posexplode(cells(F.col("header"))).alias("at", "cell"))
    numbered = split.withColumn("k", F.row_number().over(Window.partitionBy("header", "cell").orderBy("at")))  # a header's own cells
    owned = numbered.join(F.broadcast(claims), ["cell", "k"], "left")  # one row per alias of the layout
    known = F.filter(F.collect_list(F.struct("name", "at")), lambda x: x["name"].isNotNull())
    lost = F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("at", "cell"))))
    return owned.groupBy("header").agg(F.map_from_entries(known).alias("places"), F.transform(lost, lambda x: x["cell"]).alias("unknown"))


def read_valuation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valuation rows of all files with a known header, and the rejected files (source_file, unknown cells).

    A file's first line says where its columns are. Headers are resolved in the plan, each distinct one once; the files'
    maps are stored, so while they are few the lines are not shuffled. Columns a file lacks are NULL.
    """
    lines = valuation_lines(spark, path)
    first = lines.where("split_start = 0").groupBy("source_file").agg(F.min(F.struct("row_no", "line")).alias("h")).select("source_file", F.col("h.row_no").alias("header_row"), F.col("h.line").alias("header"))
    files = first.join(header_maps(first), "header", "left").drop("header")
    stored = run_folder(spark, "headers")
    files.write.parquet(stored)
    files = spark.read.schema(files.schema).parquet(stored)
    accepted = files.where(F.size("unknown") == 0).drop("unknown")
    body = lines.join(small(accepted), "source_file").where("not (split_start = 0 and row_no = header_row)")
    body = body.withColumn("cells", cells(F.col("line")))
    place = {c.name: F.col("places")[c.name] for c in VALUATION}
    raw = body.select("source_file", "split_start", "row_no", *[F.when(at.isNotNull(), F.get("cells", at)).alias(name) for name, at in place.items()])
    return clean_valuation(raw), files.where(F.size("unknown") > 0).select("source_file", "unknown")


def clean_valuation(raw: DataFrame) -> DataFrame:
    """Null tokens, types, blank-row removal and the campaign year of the file name."""
    text = {c.name: null_tokens(F.col(c.name)) for c in VALUATION}
    rows = raw.select("source_file", "split_start", "row_no", *[v.alias(k) for k, v in text.items()])
    rows = rows.where(F.coalesce(*[F.col(k) for k in text]).isNotNull())
    return rows.select(
        "source_file", "split_start", "row_no",
        file_campaign(F.col("source_file")).alias("campagne"),
        *[typed(F.col(c.name), c.kind).alias(c.name) for c in VALUATION],
    )


def file_campaign(source_file: Column) -> Column:
    """Campaign year of ``<FINESS>.<YYYY>.<MM>.…csv``."""
    return F.nullif(F.regexp_extract(source_file, r"([^/\.]+)\.(\d{4})\.[^/]*$", 2), F.lit("")).try_cast("int")


def file_identity(source_file: Column) -> dict[str, Column]:
    """Establishment, year and month of a transmission file name."""
    pattern = r"(\d{9})\.(\d{4})\.(\d{1,2})\."
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(source_file, pattern, i), F.lit(""))
    return {"file_finess": part(1), "file_year": part(2).try_cast("int"), "file_month": part(3).try_cast("int")}


def iso_text(value: Column) -> Column:
    """ISO date text of a DD/MM/YYYY or ISO cell."""
    return F.coalesce(
        F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd"),
        F.date_format(F.try_to_date(value, "dd/MM/yyyy"), "yyyy-MM-dd"),
        value,
    )


def tariff_sheet(sheet: DataFrame, name: str) -> DataFrame:
    """One exported tariff sheet with header names as columns; rows without a first cell are skipped."""
    known = {a: c for c in TARIFF for a in c.aliases}
    unknown = [h for h in sheet.columns if h not in known]
    if unknown:
        raise ValueError(f"sheet {name!r}: unknown columns {unknown}")
    first = sheet.columns[0]
    out = []
    for column in TARIFF:
        header = column.aliases[0]
        value = F.nullif(F.trim(F.col(f"`{header}`").cast("string")), F.lit("")) if header in sheet.columns else F.lit(None).cast("string")
        if column.name in ("date_debut", "date_fin"):
            value = iso_text(value)
        out.append(typed(value, column.kind).alias(column.name))
    rows = sheet.where(F.coalesce(F.trim(F.col(f"`{first}`").cast("string")), F.lit("")) != "")
    return rows.select(F.lit(name).alias("feuille_source"), *out)


def tariff_grid(sheets: dict[str, DataFrame]) -> DataFrame:
    """The sheets under one another."""
    return reduce(DataFrame.unionByName, [tariff_sheet(df, name) for name, df in sheets.items()])


def diagnosis_kit(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of the six-field pipe file; ``lines`` has line_no and line."""
    parts = F.split(windows_1252(F.col("line")), r"\|")
    split = lines.where(F.col("line") != "").withColumn("f", parts)
    def whole(i: int) -> Column:
        return F.nullif(F.trim(F.col("f")[i]), F.lit("")).try_cast("int")
    rows = split.where(F.size("f") == 6).select(
        F.trim(F.col("f")[0]).alias("code"), whole(1).alias("type_mco_had"),
        F.trim(F.col("f")[2]).alias("profil_smr"), whole(3).alias("type_psy"),
        F.col("f")[4].alias("libelle_court"), F.col("f")[5].alias("libelle_complet"),
    )
    return rows, split.where(F.size("f") != 6).drop("f")


def grouping_errors(lines: DataFrame) -> DataFrame:
    """Error table: lines with exactly three pipe fields, the others being comments."""
    parts = F.split(F.col("line"), r"\|")
    return lines.where(F.size(parts) == 3).select(
        F.trim(parts[0]).alias("code"), F.trim(parts[1]).alias("libelle"), F.trim(parts[2]).alias("type")
    )


def sectioned_acts(lines: DataFrame, by: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Tab lines attached to the latest "Erreur N" line before them.

    The forward fill runs per file; give ``by`` the column that separates independent texts.
    """
    header = F.regexp_extract(F.trim("line"), r"^Erreur\s+([^\s:\u00a0]+)", 1)
    before = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("code_erreur", F.last(F.nullif(header, F.lit("")), ignorenulls=True).over(before))
    acts = filled.where(F.col("line").contains("\t") & (header == "") & F.col("code_erreur").isNotNull())
    parts = F.split(F.col("line"), "\t", 2)
    return acts.select(*by, "code_erreur", F.trim(parts[0]).alias("code_acte"), F.trim(parts[1]).alias("libelle_acte"))


def claml_classes(spark: SparkSession, path: str) -> DataFrame:
    """Diagnosis classes of a ClaML file: (code, kind, parent_code, libelle).

    Only chapters, blocks and categories are kept, dots are removed from codes and the label is
    the preferred rubric's.
    """
    schema = (
        "_code string, _kind string, SuperClass array<struct<_code: string>>, "
        "Rubric array<struct<_kind: string, Label: array<struct<_VALUE: string>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "Class").schema(schema).load(path)
    preferred = F.filter("Rubric", lambda r: r["_kind"] == "preferred")
    return rows.where(F.col("_kind").isin("chapter", "block", "category")).select(
        F.replace(F.col("_code"), F.lit("."), F.lit("")).alias("code"),
        F.col("_kind").alias("kind"),
        F.replace(F.try_element_at(F.col("SuperClass"), F.lit(1))["_code"], F.lit("."), F.lit("")).alias("parent_code"),
        F.trim(F.try_element_at(F.try_element_at(preferred, F.lit(1))["Label"], F.lit(1))["_VALUE"]).alias("libelle"),
    )


def read_export(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A nomenclature sheet exported as CSV, all text."""
    return spark.read.csv(path, sep=sep, header=True)
