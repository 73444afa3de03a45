"""Rehabilitation scores: weights, transcoding and surcharges looked up as unique-key joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.derive import lookup
from wardflow.operators.latest import latest_by

CCAM_STAFF = "CCAM"  # fixed value: pseudo staff type of medical acts
STAFF_FALLBACK = {"80": "21", "81": "21"}  # fixed values: staff types looked up under another code
_FLAGS = ["mod_hw", "mod_lj", "mod_xh", "mod_l3"]
# Weight flags that open each place surcharge.
_CSARR_PLACES = {"HW": ["mod_hw"], "LJ": ["mod_lj"], "XH": ["mod_xh"], "L3": ["mod_l3"]}
_CSAR_PLACES = {"L1": ["mod_hw", "mod_lj"], "L2": ["mod_xh"], "L3": ["mod_l3"]}


@dataclass(frozen=True)
class ScoreTables:
    """Reference tables of the scores, as built by ``sources.nomenclatures``."""

    weights: DataFrame
    modulators: DataFrame
    transcoding: DataFrame
    time_weights: DataFrame
    place_surcharges: DataFrame
    specialised: DataFrame


def latest_weights(weights: DataFrame, nomenclature: str, by_staff: bool = False) -> DataFrame:
    """Newest weight version per act, or per act and staff type."""
    keys = ["code", "intervenant"] if by_staff else ["code"]
    rows = weights.where(F.col("nomenclature") == nomenclature)
    return latest_by(rows, keys, ["debut", "line_no"], **{c: F.col(c) for c in ("ponderation", *_FLAGS)})


def _surcharge_open(place: Column, places: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for code, flags in places.items():
        any_flag = F.lit(False)
        for flag in flags:
            any_flag = any_flag | F.col(flag)
        out = F.when(place == code, any_flag).otherwise(out)
    return out


def times(column: str = "nombre_realisations") -> Column:
    """Number of realisations; none or zero counts as one."""
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(1))


def with_transcoding(csar: DataFrame, transcoding: DataFrame) -> DataFrame:
    """Add the CSARR act of a CSAR act: exact modality, else modality "2"; NULL when there is none."""
    staff = F.coalesce(lookup(STAFF_FALLBACK, F.col("code_intervenant")), F.col("code_intervenant"))
    rows = csar.withColumns({"staff": staff, "coll": F.coalesce("modalite_collective", F.lit(0))})
    exact = transcoding.select(
        F.col("code_csar").alias("code_principal"), F.col("intervenant").alias("staff"),
        F.col("acte_coll").alias("_mode"), F.col("code_csarr").alias("_exact"),
    )
    any_mode = exact.where("_mode = '2'").select("code_principal", "staff", F.col("_exact").alias("_any"))
    return (
        rows.withColumn("_mode", F.col("coll").cast("string"))
        .join(exact, ["code_principal", "staff", "_mode"], "left")
        .join(any_mode, ["code_principal", "staff"], "left")
        .withColumn("code_csarr", F.coalesce("_exact", "_any")).drop("_mode", "_exact", "_any")
    )


def csarr_scores(acts: DataFrame, tables: ScoreTables) -> DataFrame:
    """Weighted CSARR acts: (act columns, act_code, staff_code, n, score)."""
    weights = latest_weights(tables.weights, "CSARR").withColumnRenamed("code", "code_principal")
    rates = tables.modulators.withColumnRenamed("code", "code_modulateur_lieu")
    rows = acts.where("code_intervenant is not null").join(weights, "code_principal").join(rates, "code_modulateur_lieu", "left")
    single = F.coalesce(F.nullif("nombre_reel_patients", F.lit(0)), F.lit(1)) <= 1
    rate = F.when(single, F.col("individuel")).otherwise(F.col("collectif"))
    percent = F.when(_surcharge_open(F.col("code_modulateur_lieu"), _CSARR_PLACES), F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.withColumns({
        "act_code": F.col("code_principal"), "staff_code": F.col("code_intervenant"), "n": times(),
    }).withColumn("score", F.col("ponderation") * (1 + percent / 100) * F.col("n"))


def csar_scores(acts: DataFrame, tables: ScoreTables) -> DataFrame:
    """Weighted CSAR acts, transcoded; acts without a correspondence or with a zero weight drop out."""
    rows = with_transcoding(acts.where("code_intervenant is not null"), tables.transcoding).where("code_csarr is not null")
    packed = latest_weights(tables.weights, "CSARR", by_staff=True).select(
        F.col("code").alias("code_csarr"), F.col("intervenant").alias("staff"),
        F.struct("ponderation", *_FLAGS).alias("w"),
    )
    anyone = packed.where("staff = '00'").select("code_csarr", F.col("w").alias("w00"))
    weighted = (
        rows.join(packed, ["code_csarr", "staff"], "left").join(anyone, "code_csarr", "left")
        .withColumn("w", F.coalesce("w", "w00")).where("w.ponderation <> 0")
        .select("*", "w.*").drop("w", "w00").withColumnRenamed("ponderation", "act_weight")
    )
    time = tables.time_weights.select(F.col("modalite").alias("_t"), F.col("ponderation").alias("time_weight"))
    place = tables.place_surcharges.withColumnRenamed("modalite", "code_modulateur_lieu")
    joined = (
        weighted.withColumn("_t", F.coalesce(F.nullif("code_modulateur_temps", F.lit("")), F.lit("Vide")))
        .join(time, "_t", "left").join(place, "code_modulateur_lieu", "left").drop("_t")
    )
    retained = F.greatest(F.coalesce("time_weight", F.lit(0.0)), F.col("act_weight"))
    rate = F.when(F.col("coll") != 0, F.col("collectif")).otherwise(F.col("individuel"))
    percent = F.when(_surcharge_open(F.col("code_modulateur_lieu"), _CSAR_PLACES), F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.withColumns({
        "act_code": F.col("code_csarr"), "staff_code": F.col("code_intervenant"), "n": times(),
    }).withColumn("score", retained * (1 + percent / 100) * F.col("n"))


def ccam_scores(acts: DataFrame, tables: ScoreTables) -> DataFrame:
    """Weighted CCAM acts under one pseudo staff type."""
    weights = latest_weights(tables.weights, "CCAM").withColumnRenamed("code", "code_ccam")
    return acts.join(weights, "code_ccam").withColumns({
        "act_code": F.col("code_ccam"), "staff_code": F.lit(CCAM_STAFF), "n": times(),
    }).withColumn("score", F.col("ponderation") * F.col("n"))


def staff_scores(
    csarr: DataFrame, csar: DataFrame, ccam: DataFrame, stay_groups: DataFrame, tables: ScoreTables, by: list[str]
) -> DataFrame:
    """Global and specialised score per staff type.

    The act tables carry ``by`` and the stay; ``stay_groups`` gives each stay's group (``by``,
    stay, gn). An act is specialised when it is listed for the stay's group. Acts are summed per
    (stay, act, staff) before the group lookups.
    """
    keys = [*by, "stay"]
    parts = [csarr_scores(csarr, tables), csar_scores(csar, tables), ccam_scores(ccam, tables)]
    scored = None
    for part in parts:
        slim = part.groupBy(*keys, "act_code", "staff_code").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
        scored = slim if scored is None else scored.unionByName(slim)
    special = tables.specialised.select("gn", F.col("code_acte").alias("act_code"), F.lit(True).alias("special"))
    joined = scored.join(stay_groups, keys, "left").join(special, ["gn", "act_code"], "left")
    return joined.groupBy(*by, F.col("staff_code").alias("code")).agg(
        F.sum("n").alias("n"), F.sum("score").alias("globale"),
        F.sum(F.when(F.col("special"), F.col("score")).otherwise(F.lit(0.0))).alias("specialisee"),
    )


def ignored_acts(csar: DataFrame, transcoding: DataFrame) -> DataFrame:
    """CSAR acts without any CSARR correspondence."""
    rows = with_transcoding(csar.where("code_intervenant is not null"), transcoding)
    return rows.where("code_csarr is null").withColumns({
        "modalite": F.when(F.col("coll") != 0, F.lit("Collectif")).otherwise(F.lit("Individuel")),
        "n": times(),
    })
