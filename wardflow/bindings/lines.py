"""Transmission files rendered from the supplied tables, with the faults real files have.

The lines are written to the shared folder and scanned back, as a drop folder would be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.tables import Tables
from wardflow.sources.fixed_width import read_lines, render, render_versions
from wardflow.sources.layouts import ADMIN, WEEKLY, Family

# Faults by record number: see ``oracle`` texts of the ingest queries.
UNKNOWN, SHORT, BAD_DATE, BAD_NUMBER, BAD_ACT_DATE = 37, 41, 43, 47, 53


def _items(children: DataFrame, family: Family, name: str) -> DataFrame:
    """(rhs_id, item): block items (seq, x), x the padded text, in a column of the block's name."""
    block = next(b for layout in family.layouts for b in layout.blocks if b.name == name)
    pieces = []
    for f in block.fields:
        value = F.col(f.name).cast("string") if f.name in children.columns else F.lit("")
        if f.kind == "D":
            value = F.concat(F.substring(value, 9, 2), F.substring(value, 6, 2), F.substring(value, 1, 4))
        value = F.coalesce(value, F.lit(""))
        pieces.append(F.when(value != "", F.lpad(value, f.width, "0")).otherwise(F.lpad(value, f.width, " ")) if f.kind == "N" else F.rpad(value, f.width, " "))
    return children.select("rhs_id", F.struct("seq", F.concat(*pieces).alias("x")).alias(name))


def weekly_rows(t: Tables, block_faults: bool = False) -> DataFrame:
    """(finess_epmsi, value): rendered lines of all weekly records; ``n`` numbers the fault pattern.

    The items of all blocks are brought together by record once, and all versions are rendered in one pass.
    """
    number = F.expr("cast(substring(numero_admin_sejour, 1, 9) as bigint) + cast(substring(numero_semaine, 1, 2) as int)")
    blocks = {"das": t.das, "csarr": t.csarr, "csar": t.csar, "ccam": t.ccam}
    items = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_items(x, WEEKLY, name) for name, x in blocks.items()])
    per_record = items.select("rhs_id", F.struct(*blocks).alias("item")).groupBy("rhs_id").agg(F.collect_list("item").alias("items"))
    rows = t.records.withColumn("n", number).join(per_record.hint("merge"), "rhs_id", "left")
    # versions before M1D have no third counter nor block
    rows = rows.withColumn("n3_nb_csar", F.expr("case when version_format_rhs_groupe = 'M1D' then n3_nb_csar else 0 end"))

    def text(block: str) -> Column:
        own = F.sort_array(F.col(f"items.{block}")).getField("x")  # NULL where an item is of another block
        return F.coalesce(F.array_join(own, ""), F.lit(""))

    version = F.col("version_format_rhs_groupe")
    rows = rows.where(version.isin(*WEEKLY.versions))
    line = render_versions(rows, WEEKLY, version, {b: text(b) for b in blocks})
    fixed = reduce(lambda out, lay: out.when(version == lay.version, lay.fixed_length), WEEKLY.layouts[1:], F.when(version == WEEKLY.layouts[0].version, WEEKLY.layouts[0].fixed_length))
    out = rows.select("finess_epmsi", line.alias("line"), "n", version.alias("v"), fixed.alias("fixed"), "n1_nb_das", "n2_nb_csarr", "n3_nb_csar")
    return out.select("finess_epmsi", _faults(F.col("line"), block_faults).alias("value"))


def weekly_folder(t: Tables, block_faults: bool = False) -> str:
    return t.dropped("rhs-faults" if block_faults else "rhs", lambda: weekly_rows(t, block_faults))


def weekly_lines(t: Tables, block_faults: bool = False) -> DataFrame:
    """Scanned lines of all weekly records."""
    return _scanned(t, weekly_folder(t, block_faults), "rhs_")


def _scanned(t: Tables, folder: str, prefix: str) -> DataFrame:
    """Lines of text files; a transmission (``source_file``) may be several part files."""
    name = F.concat(F.lit(prefix), F.regexp_extract("source_file", "finess_epmsi=([0-9]+)", 1), F.lit(".txt"))
    part = F.substring_index("source_file", "/", -1)
    return read_lines(t.spark, folder).withColumns({"source_file": name, "part_file": part})


def _faults(line: Column, block_faults: bool) -> Column:
    out = F.when(F.col("n") % UNKNOWN == 0, F.overlay(line, F.lit("M9Z"), F.lit(11)))
    out = out.when(F.col("n") % SHORT == 0, F.expr("substring(line, 1, length(line) - 3)"))
    birth = F.when(F.col("v") == "M1B", F.lit(81)).otherwise(F.lit(82))
    out = out.when(F.col("n") % BAD_DATE == 0, F.overlay(line, F.lit("ABCDEFGH"), birth))
    if block_faults:  # in the first item of a block: a number of the CSARR acts, a date of the CSAR acts
        csarr = F.col("fixed") + 8 * F.col("n1_nb_das")
        csar = csarr + 35 * F.col("n2_nb_csarr")
        out = out.when((F.col("n") % BAD_NUMBER == 0) & (F.col("n2_nb_csarr") > 0), F.overlay(line, F.lit("xx"), (csarr + 20).cast("int")))
        out = out.when((F.col("n") % BAD_ACT_DATE == 0) & (F.col("n3_nb_csar") > 0), F.overlay(line, F.lit("ABCDEFGH"), (csar + 19).cast("int")))
    return out.otherwise(line)


def admin_lines(t: Tables) -> DataFrame:
    """Scanned lines of all administrative rows, in the current version."""
    rows = t.admin.withColumns({
        "nombre_disciplines_prestations": F.lit(1), "nom_medecin_traitant": F.lit("MARTIN"), "prenom_medecin_traitant": F.lit("CLAUDE"),
        "numero_immatriculation_individuel": F.col("numero_immatriculation_assure"),
    })
    block = F.concat(F.rpad(F.lit("519"), 5, " "), F.rpad(F.lit(""), 16, "0"), F.lit("003"), F.rpad(F.lit(""), 26, "0"))
    folder = t.dropped("vid", lambda: render(rows, ADMIN, "V016", {"dmt": block}).select("finess_epmsi", F.col("line").alias("value")))
    return _scanned(t, folder, "vid_")
