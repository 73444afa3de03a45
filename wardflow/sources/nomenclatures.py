"""Nomenclature tables from exported sheets: catalogues, weights, transcoding and hierarchies.

Every function takes the sheet as a DataFrame with named columns and returns the table's rows;
``latest_labels`` merges yearly files, the newest label winning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.latest import last_wins

# Code length by kind of the group hierarchy, top first.
GROUP_LENGTHS = {"CM": 2, "GN": 4, "GR": 5, "GL": 6, "GME": 7}

# Chapters of the CSAR act catalogue.
CSAR_CHAPTERS = {
    "01": "FONCTIONS CEREBRALES",
    "02": "FONCTIONS SENSORIELLES ET DOULEUR",
    "03": "FONCTIONS DE LA VOIX ET DE LA PAROLE",
    "04": "FONCTIONS CARDIAQUES, VASCULAIRES ET RESPIRATOIRES",
    "05": "FONCTIONS DIGESTIVES ET NUTRITION",
    "06": "FONCTIONS GENITO-URINAIRES ET REPRODUCTIVES",
    "07": "FONCTIONS DE L'APPAREIL LOCOMOTEUR ET LIEES AU MOUVEMENT",
    "08": "FONCTIONS DE LA PEAU ET DES PHANERES",
    "09": "APPAREILLAGE",
    "10": "EDUCATION ET PREVENTION",
    "11": "ACTIVITE ET PARTICIPATION",
}
TITLE_KINDS = {1: "chapitre", 2: "sous_chapitre", 3: "paragraphe", 4: "sous_paragraphe"}


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _filled(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def code_labels(sheet: DataFrame) -> DataFrame:
    """Two-column code/label file (staff types)."""
    return sheet.select(_text("code").alias("code"), _text("libelle").alias("libelle"))


def group_hierarchy(sheet: DataFrame) -> DataFrame:
    """Group codes with their parent: the code cut to the length of the kind above."""
    kinds = list(GROUP_LENGTHS)
    code, kind = _text("code"), _text("kind")
    parent = F.lit(None).cast("string")
    for above, below in zip(kinds, kinds[1:]):
        parent = F.when(kind == below, F.substring(code, 1, GROUP_LENGTHS[above])).otherwise(parent)
    return sheet.where(_filled("kind").isNotNull()).select(
        code.alias("code"), kind.alias("kind"), parent.alias("parent_code"),
        _text("libelle_court").alias("libelle_court"), _text("libelle_long").alias("libelle_long"),
    )


def group_levels(groups: DataFrame, code: str = "code_gme") -> DataFrame:
    """All five levels of full group codes, one row per code and kind."""
    levels = [
        F.struct(F.lit(k).alias("kind"), F.substring(F.col(code), 1, n).alias("code"))
        for k, n in GROUP_LENGTHS.items()
    ]
    return groups.select(F.explode(F.array(*levels)).alias("l")).select("l.kind", "l.code").distinct()


def catalogue_acts(sheet: DataFrame) -> DataFrame:
    """Medical acts: type-L lines, deepest heading as parent, the newest line's label.

    Columns read: code, typo, libelle, paragraphe, sous_paragraphe, date_debut.
    """
    lines = sheet.where((F.col("typo") == "L") & F.col("code").isNotNull())
    newest = F.max_by(
        F.struct(
            _text("libelle").alias("libelle"),
            F.coalesce(_filled("sous_paragraphe"), _filled("paragraphe")).alias("parent_code"),
        ),
        F.struct(F.coalesce("date_debut", F.lit("")), "line_no"),
    )
    return lines.groupBy(_text("code").alias("code")).agg(newest.alias("n")).select("code", "n.*")


def catalogue_hierarchy(sheet: DataFrame) -> DataFrame:
    """Four heading levels built from act lines, the newest known label of each heading winning."""
    p, sp = _filled("paragraphe"), _filled("sous_paragraphe")
    parts = F.split(p, r"\.")
    chapter, sub = parts[0], F.array_join(F.slice(parts, 1, 2), ".")
    def level(code: Column, kind: str, parent: Column, label: str, depth: int) -> Column:
        return F.struct(
            code.alias("code"), F.lit(kind).alias("kind"), parent.alias("parent_code"),
            _text(label).alias("libelle"), F.lit(depth).alias("depth"),
        )
    none = F.lit(None).cast("string")
    levels = F.array(
        level(chapter, "chapitre", none, "chapitre_libelle", 1),
        level(sub, "sous_chapitre", chapter, "sous_chapitre_libelle", 2),
        level(p, "paragraphe", sub, "paragraphe_libelle", 3),
        level(sp, "sous_paragraphe", p, "sous_paragraphe_libelle", 4),
    )
    rows = sheet.where((F.col("typo") == "L") & p.isNotNull()).select(
        "line_no", F.coalesce("date_debut", F.lit("")).alias("since"), F.explode(levels).alias("l")
    ).where("l.code is not null")
    newest = F.max_by(
        F.struct("l.kind", "l.parent_code", "l.libelle"), F.struct("since", "line_no", "l.depth")
    )
    return rows.groupBy(F.col("l.code").alias("code")).agg(newest.alias("n")).select("code", "n.*")


def title_hierarchy(sheet: DataFrame) -> DataFrame:
    """Headings of title lines: depth is the number of dotted parts, the parent drops the last one."""
    code = _text("code_hier")
    parts = F.split(code, r"\.")
    depth = F.size(parts)
    kind = F.concat(F.lit("niveau_"), depth.cast("string"))
    for n, name in TITLE_KINDS.items():
        kind = F.when(depth == n, F.lit(name)).otherwise(kind)
    parent = F.when(depth > 1, F.array_join(F.slice(parts, F.lit(1), depth - 1), "."))
    return sheet.where((F.col("typo") == "T") & (code != "")).select(
        code.alias("code"), kind.alias("kind"), parent.alias("parent_code"), _text("libelle").alias("libelle")
    )


def title_acts(sheet: DataFrame) -> DataFrame:
    """Rehabilitation acts of the same sheet: type-L lines with their heading."""
    return sheet.where((F.col("typo") == "L") & _filled("code").isNotNull()).select(
        _text("code").alias("code"), _text("libelle").alias("libelle"), _filled("code_hier").alias("parent_code")
    )


def chapter_acts(sheet: DataFrame) -> DataFrame:
    """Act catalogue whose chapter is the first two characters of the code."""
    return sheet.where(_filled("code").isNotNull()).select(
        _text("code").alias("code"), _text("libelle").alias("libelle"),
        F.substring(_text("code"), 1, 2).alias("parent_code"),
    )


def chapter_table(acts: DataFrame) -> DataFrame:
    """Chapters of a two-character-prefix catalogue: the fixed label list."""
    spark = acts.sparkSession
    rows = [(c, "chapitre", None, label) for c, label in CSAR_CHAPTERS.items()]
    return spark.createDataFrame(rows, "code string, kind string, parent_code string, libelle string")


def specialised_acts(gn_lists: DataFrame, list_acts: DataFrame) -> DataFrame:
    """(group, act) pairs: groups to their list, lists to their acts; groups without a list drop out.

    Columns read: gn, gn_liste | code_acte, type_acte, gn_liste.
    """
    groups = gn_lists.where(
        _filled("gn").isNotNull() & (F.upper(_text("gn_liste")) != "PAS DE LISTE") & _filled("gn_liste").isNotNull()
    ).groupBy(_text("gn").alias("gn")).agg(F.max_by(_text("gn_liste"), "line_no").alias("gn_liste"))
    acts = list_acts.where(_filled("code_acte").isNotNull() & _filled("gn_liste").isNotNull()).groupBy(
        _text("gn_liste").alias("gn_liste"), _text("code_acte").alias("code_acte")
    ).agg(F.min_by(F.upper(_filled("type_acte")), "line_no").alias("nomenclature"))
    return groups.join(acts, "gn_liste").select("gn", "code_acte", "nomenclature")


def act_weights(sheet: DataFrame) -> DataFrame:
    """Weight table: numeric weight and validity start, place flags as booleans."""
    flags = ["mod_hw", "mod_lj", "mod_xh", "mod_l3"]
    return sheet.where(_filled("code").isNotNull()).select(
        "line_no", _text("code").alias("code"), "nomenclature", _filled("intervenant").alias("intervenant"),
        F.coalesce(F.col("ponderation_patient").try_cast("double"), F.lit(0.0)).alias("ponderation"),
        F.coalesce(_filled("debut").try_cast("int"), F.lit(-1)).alias("debut"),
        *[F.coalesce(F.col(f) == "x", F.lit(False)).alias(f) for f in flags],
    )


def surcharge_rates(sheet: DataFrame, key: str) -> DataFrame:
    """Place surcharges in percent; text such as "sans objet" is no rate."""
    return sheet.where(_filled(key).isNotNull()).select(
        _text(key).alias(key),
        F.col("majoration_individuel").try_cast("double").alias("individuel"),
        F.col("majoration_collectif").try_cast("double").alias("collectif"),
    )


def time_weights(sheet: DataFrame) -> DataFrame:
    """Time weights by modality; no modality is ``Vide``. Columns read: categorie, modalite, ponderation."""
    return sheet.where(F.col("categorie") == "Temps").select(
        F.coalesce(_filled("modalite"), F.lit("Vide")).alias("modalite"),
        F.coalesce(F.col("ponderation").try_cast("double"), F.lit(0.0)).alias("ponderation"),
    )


def place_surcharges(sheet: DataFrame) -> DataFrame:
    """Place modalities of the same sheet."""
    return surcharge_rates(sheet.where(F.col("categorie") == "Lieu"), "modalite")


def transcoding_detail(sheet: DataFrame) -> DataFrame:
    """(CSAR act, staff, collective modality) to CSARR act; a blank modality is "0"."""
    return sheet.where(_filled("code_csar").isNotNull()).select(
        _text("code_csar").alias("code_csar"), _filled("intervenant").alias("intervenant"),
        F.coalesce(_filled("acte_coll"), F.lit("0")).alias("acte_coll"), _filled("code_csarr").alias("code_csarr"),
    )


def transcoding_pairs(sheet: DataFrame) -> DataFrame:
    """CSARR to CSAR correspondence with both labels."""
    return sheet.where(_filled("code_csarr").isNotNull()).select(
        _text("code_csarr").alias("code_csarr"), _text("libelle_csarr").alias("libelle_csarr"),
        _filled("code_csar").alias("code_csar"), _filled("libelle_csar").alias("libelle_csar"),
    )


def latest_labels(rows: DataFrame, key: list[str]) -> DataFrame:
    """Yearly nomenclature files merged: newest year, then file name, then line wins."""
    return last_wins(rows, key, ["source_annee", "source_file", "line_no"])
