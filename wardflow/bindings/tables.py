"""The supplied star-schema tables in the roles of the hospital tables.

Orders are stays, line items weekly records and acts, parts the nomenclatures. Everything is
derived by column expressions from the whole tables; ``oracle`` holds the same views as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.presence import STAY, last_presence, with_week
from wardflow.plans.dashboard import with_axes
from wardflow.plans.periods import reporting_periods, weeks_in_period
from wardflow.plans.scores import ScoreTables
from wardflow.session import run_folder
from wardflow.sources import nomenclatures as nom


def diag(x: str) -> str:
    """SQL text of the diagnosis code of an integer."""
    return (
        f"concat(substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({x} % 26 as int) + 1, 1), "
        f"lpad(cast({x} % 90 as string), 2, '0'), cast({x} % 10 as string))"
    )


def gme(x: str) -> str:
    """SQL text of the group code of an integer."""
    return (
        f"case when {x} % 23 = 0 then '9096ZZ0' else concat(lpad(cast({x} % 16 + 1 as string), 2, '0'), "
        f"lpad(cast({x} % 7 as string), 2, '0'), substring('PSTUHIJKL', cast({x} % 9 as int) + 1, 1), "
        f"substring('ABC', cast(({x} % 5) % 3 as int) + 1, 1), cast({x} % 3 as string)) end"
    )


BIRTH = "date_format(date_add(date'1920-01-01', cast(o_custkey * 37 % 36500 as int)), 'yyyy-MM-dd')"
SEX = "case when o_custkey % 50 = 0 then '3' else cast(1 + o_custkey % 2 as string) end"
FINESS = "concat('68000000', substring(o_orderpriority, 1, 1))"
RECORD_ID = "concat(lpad(cast(l_orderkey as string), 9, '0'), '|', lpad(cast(iw as string), 2, '0'), cast(iy as string), '|', l_returnflag)"
STAY_NUMBER = "lpad(cast(o_orderkey as string), 9, '0')"
ACT_KINDS = {"n2_nb_csarr": "l_partkey % 8 < 4", "n3_nb_csar": "l_partkey % 8 in (4, 5)", "n4_nb_ccam": "l_partkey % 8 = 6"}
DEPENDENCE = ["habillage_toilette", "deplacement", "alimentation", "continence", "comportement", "relation"]


FILE_LINES = 500_000  # of one rendered file
UNIT_GROUPS = {"court": ["A", "N"], "retour": ["R", "N"]}
_STORED: dict[tuple[str, str, str], str] = {}  # written tables of this process by (application, folder, name)


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            "*", F.expr(FINESS).alias("finess_epmsi"),
            F.expr(STAY_NUMBER).alias("numero_admin_sejour"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their ISO week and the id of the weekly record they belong to."""
        day = F.to_date("l_shipdate")
        return self.raw("lineitem").withColumns({
            "d": day, "iy": F.year(F.date_add(day, 3 - F.weekday(day))), "iw": F.weekofyear(day), "dow": F.weekday(day),
        }).withColumn("rhs_id", F.expr(RECORD_ID))

    @cached_property
    def records(self) -> DataFrame:
        """Weekly records as a decoded transmission would give them."""
        return self._decoded(self._weekly())

    def _weekly(self) -> DataFrame:
        """What the columns of a weekly record are made of, one narrow row per record."""
        grouped = self.lines.groupBy("l_orderkey", "iy", "iw", "l_returnflag").agg(
            F.bit_or(F.expr("shiftleft(1, dow)")).alias("bits"),
            F.max("l_partkey").alias("pk"),
            F.count_if(F.expr("l_linestatus = 'O'")).alias("n1_nb_das"),
            *[F.count_if(F.expr(test)).alias(name) for name, test in ACT_KINDS.items()],
        )
        stays = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "finess_epmsi", "order_day")
        return grouped.join(stays, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")

    def _decoded(self, weekly: DataFrame) -> DataFrame:
        text = {
            "numero_semaine": "concat(lpad(cast(iw as string), 2, '0'), cast(iy as string))",
            "jours_hors_weekend": "reverse(lpad(bin(bits & 31), 5, '0'))", "jours_weekend": "reverse(lpad(bin(shiftright(bits, 5)), 2, '0'))",
            "numero_unite_medicale": "l_returnflag", "code_gme": f"case when pk % 101 = 0 then null else {gme('pk')} end",
            "indicateur_erreur": "case when pk % 13 = 0 then 'E' when pk % 29 = 0 then 'F' end",
            "code_retour_groupage": "lpad(cast(pk % 5 as string), 3, '0')",
            "version_format_rhs_groupe": "case when iy <= 1996 then 'M1B' when iy <= 1998 then 'M1C' else 'M1D' end",
            **{f"dependance_{n}": f"case when (pk + {i}) % 11 = 0 then null else cast(1 + (pk + {i}) % 4 as string) end" for i, n in enumerate(DEPENDENCE)},
            "date_debut_sejour": "order_day", "date_entree_um": "order_day",
            "date_fin_sejour": "case when o_orderstatus = 'F' and (o_orderkey + iw) % 4 = 0 then date_format(date_add(make_date(iy, 1, 4), cast(6 - weekday(make_date(iy, 1, 4)) + (iw - 1) * 7 as int)), 'yyyy-MM-dd') end",
            "date_naissance": BIRTH, "sexe": SEX,
            "code_postal_residence": "lpad(cast(o_custkey * 7 % 99000 as string), 5, '0')",
            "type_hospitalisation": "case o_orderkey % 4 when 0 then '2' when 1 then '3' else '1' end",
            "mode_entree_um": "cast(6 + pk % 3 as string)",
            "manifestation_morbide_principale": diag("pk"),
            "affection_etiologique": f"case when pk % 3 = 0 then {diag('(pk + 5)')} end",
        }
        return weekly.select(
            F.expr(RECORD_ID.replace("l_orderkey", "o_orderkey")).alias("rhs_id"), "finess_epmsi", F.expr(STAY_NUMBER).alias("numero_admin_sejour"), *[F.expr(v).alias(k) for k, v in text.items()],
            F.expr("cast(o_orderkey as string)").alias("stay"), F.col("iy").alias("iso_year"), F.col("iw").alias("week"),
            "n1_nb_das", *ACT_KINDS, F.lit("lineitem").alias("source_file"),
            F.expr("cast(iy as bigint) * 1000 + iw * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").alias("line_no"),
        )

    def stored(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once per application to the shared folder and read back.

        The weekly rows and the valuation table are what a load would have left behind; every
        section scans a few columns of them instead of grouping the line items again for each of its uses.
        """
        return self.spark.read.parquet(self.kept(name, lambda path: rows.write.parquet(path)))

    def kept(self, name: str, write: Callable[[str], None]) -> str:
        """Path that ``write`` filled once per application."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = run_folder(self.spark, name)
            write(path)
            _STORED[key] = path
        return _STORED[key]

    def dropped(self, name: str, rows: Callable[[], DataFrame]) -> str:
        """Folder of packed text files by establishment, as transmissions were dropped: written once per application.

        A packed file is read by one task, so its number of lines is bounded.
        """
        return self.kept(name, lambda path: rows().write.partitionBy("finess_epmsi").option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip"))

    @cached_property
    def weeks(self) -> DataFrame:
        """The weekly table. Its narrow rows are stored, so a section derives only the columns that it uses."""
        return with_week(self._decoded(self.stored("weeks", self._weekly())))

    @cached_property
    def periods(self) -> DataFrame:
        return self.stored("periods", reporting_periods(self.weeks))

    @cached_property
    def in_period(self) -> DataFrame:
        return weeks_in_period(self.weeks, self.periods)

    @cached_property
    def axis_rows(self) -> DataFrame:
        """The records inside the periods, once for each secondary dashboard: made from the stored rows where they are read."""
        return with_axes(self.in_period, UNIT_GROUPS)

    @cached_property
    def das(self) -> DataFrame:
        return self.lines.where("l_linestatus = 'O'").select(
            "rhs_id", F.col("l_linenumber").alias("seq"),
            F.expr(f"case when l_partkey % 53 = 0 then null else {diag('l_partkey')} end").alias("code_das"),
        )

    @cached_property
    def csarr(self) -> DataFrame:
        cols = {
            "code_principal": "concat('ACT', lpad(cast(l_partkey % 300 as string), 4, '0'))",
            "code_modulateur_lieu": "case l_suppkey % 6 when 0 then 'HW' when 1 then 'LJ' when 2 then 'XH' when 3 then 'L3' end",
            "code_intervenant": "case when l_suppkey % 37 = 5 then null else lpad(cast(l_suppkey % 32 as string), 2, '0') end",
            "nombre_realisations": "cast(l_quantity as int) % 5", "nombre_reel_patients": "l_linenumber % 3",
            "date_realisation": "date_format(d, 'yyyy-MM-dd')",
        }
        return self._acts("l_partkey % 8 < 4", cols)

    @cached_property
    def csar(self) -> DataFrame:
        cols = {
            "code_principal": "concat('C', lpad(cast(l_partkey % 60 as string), 4, '0'))",
            "code_modulateur_lieu": "case l_suppkey % 5 when 0 then 'L1' when 1 then 'L2' when 2 then 'L3' end",
            "code_modulateur_temps": "case when l_linenumber % 6 = 5 then null else concat('T', cast(l_linenumber % 6 as string)) end",
            "code_intervenant": "case l_suppkey % 8 when 0 then '80' when 1 then '81' else lpad(cast(l_suppkey % 32 as string), 2, '0') end",
            "modalite_collective": "case when l_linenumber % 3 = 0 then null else l_linenumber % 2 end",
            "nombre_realisations": "cast(l_quantity as int) % 4", "date_realisation": "date_format(d, 'yyyy-MM-dd')",
        }
        return self._acts("l_partkey % 8 in (4, 5)", cols)

    @cached_property
    def ccam(self) -> DataFrame:
        cols = {
            "code_ccam": "concat('CCA', lpad(cast(l_partkey % 90 as string), 4, '0'))",
            "nombre_realisations": "cast(l_quantity as int) % 3", "date_realisation": "date_format(d, 'yyyy-MM-dd')",
        }
        return self._acts("l_partkey % 8 = 6", cols)

    def _acts(self, test: str, cols: dict[str, str]) -> DataFrame:
        return self.lines.where(test).select(
            "rhs_id", F.col("l_linenumber").alias("seq"), *[F.expr(v).alias(k) for k, v in cols.items()]
        )

    @cached_property
    def admin(self) -> DataFrame:
        cols = {
            "stay": "cast(o_orderkey as string)",
            "numero_ipp": "case when o_custkey % 97 = 0 then null else cast(o_custkey as string) end",
            "sexe_beneficiaire": SEX, "date_naissance_beneficiaire": BIRTH, "date_hospitalisation": "order_day",
            "date_entree": "case when o_orderkey % 31 = 0 then null else order_day end",
            "date_sortie": "case when o_orderstatus = 'O' then null else date_format(date_add(o_orderdate, cast(o_orderkey % 90 as int)), 'yyyy-MM-dd') end",
            "numero_immatriculation_assure": "case when o_orderkey % 41 = 0 then 'XXXX' when o_orderkey % 43 = 0 then null else lpad(cast(o_custkey as string), 13, '1') end",
            "montant_facturer_tm": "cast(round(o_totalprice * 100) as bigint)",
        }
        return self.orders.where("o_orderkey % 29 <> 0").select(
            "finess_epmsi", "numero_admin_sejour", *[F.expr(v).alias(k) for k, v in cols.items()],
            F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("line_no"),
        )

    @cached_property
    def valuation(self) -> DataFrame:
        return self.stored("valuation", self._valuation())

    def _valuation(self) -> DataFrame:
        """Valuation rows in the shapes of the four billing cases."""
        sunday = F.expr("year(date_add(d, 6 - dow))")
        weekly = self.lines.groupBy(F.col("l_orderkey").alias("k"), "iy", "iw", sunday.alias("sy")).agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amt")
        )
        span = weekly.groupBy("k").agg(F.max("sy").alias("last_sy"))
        code = "concat(cast(iy as string), lpad(cast(iw as string), 2, '0'))"
        part_time = weekly.where("k % 5 = 0").join(span, "k").select(
            "k", F.expr("case when k % 10 = 0 then last_sy else sy end").alias("campagne"),
            F.expr(code).alias("numero_semaine"), F.expr(code).alias("numero_rha"),
            F.expr("lpad(cast(iw as string), 2, '0')").alias("numero_semaine_htp"),
            F.lit("P").alias("type_hospitalisation"), F.col("amt").cast("decimal(18,2)").alias("amt"),
        )
        def full(df: DataFrame) -> DataFrame:
            return df.select(
                "k", "campagne", F.expr("concat(cast(campagne as string), '01')").alias("numero_semaine"),
                F.lit("000").alias("numero_rha"), F.lit(None).cast("string").alias("numero_semaine_htp"),
                F.lit("C").alias("type_hospitalisation"), F.col("amt").cast("decimal(18,2)").alias("amt"),
            )
        yearly = full(weekly.where("k % 7 = 0 and k % 5 <> 0").groupBy("k", F.col("sy").alias("campagne")).agg(F.sum("amt").alias("amt")))
        o = self.orders
        single = full(
            o.join(span, F.col("o_orderkey") == F.col("k"), "left").where("(o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0) or k is null").select(
                F.col("o_orderkey").alias("k"), F.coalesce("last_sy", F.year("o_orderdate")).alias("campagne"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("amt"),
            )
        )
        rows = part_time.unionByName(yearly).unionByName(single).join(o.select("o_orderkey", "o_orderstatus", "finess_epmsi"), F.col("k") == F.col("o_orderkey"))
        dec = "decimal(18,2)"
        rows = rows.withColumns({
            "montant_br_gmt": F.expr(f"case when k % 23 = 0 then cast(0 as {dec}) else amt end"),
            "montant_br_gmth": F.expr(f"case when k % 3 = 0 and k % 23 <> 0 then cast((k % 1000) * 0.25 as {dec}) end"),
            "montant_br_trans": F.expr(f"case when k % 4 = 0 then cast((k % 200) * 0.5 as {dec}) end"),
            "montant_am_med": F.expr(f"case when k % 6 = 0 then cast(15.5 as {dec}) end"),
            "montant_br_supp_cancero": F.expr(f"case when k % 9 = 0 then cast(20.25 as {dec}) end"),
        })
        return rows.select(
            "finess_epmsi", F.expr("cast(k as string)").alias("numero_admin_sejour"), F.expr("cast(k as string)").alias("stay"),
            "campagne", "numero_semaine", "numero_rha", "numero_semaine_htp", "type_hospitalisation",
            "montant_br_gmt", "montant_br_gmth", "montant_br_trans", "montant_am_med", "montant_br_supp_cancero",
            F.expr(f"cast(montant_br_gmt + coalesce(montant_br_gmth, 0) as {dec})").alias("montant_br_sej"),
            F.expr(
                "case when k % 11 = 0 then null else cast(montant_br_gmt + coalesce(montant_br_gmth, 0) + coalesce(montant_br_trans, 0)"
                f" + coalesce(montant_am_med, 0) + coalesce(montant_br_supp_cancero, 0) as {dec}) end"
            ).alias("montant_br_tot"),
            F.expr("case when o_orderstatus = 'P' and k % 3 = 0 then 1 when k % 2 = 0 then 0 end").alias("nv_chain"),
            F.expr("case when k % 17 = 0 then 1 else 0 end").alias("nv_attente_dts"),
            F.expr("case when k % 19 = 0 then 1 end").alias("nv_nonfactam"),
            F.expr(f"case when k % 13 = 0 then '9096ZZ0' else {gme('k')} end").alias("code_gme"),
        )

    @cached_property
    def last_sunday(self) -> DataFrame:
        return last_presence(self.weeks)

    # --- nomenclatures ------------------------------------------------------------------------

    @cached_property
    def part(self) -> DataFrame:
        return self.raw("part").withColumnRenamed("p_partkey", "p")

    @cached_property
    def weight_sheet(self) -> DataFrame:
        cols = {
            "code": "case when p % 3 = 0 then concat('CCA', lpad(cast(p % 90 as string), 4, '0')) else concat('ACT', lpad(cast(p % 300 as string), 4, '0')) end",
            "nomenclature": "case when p % 3 = 0 then 'CCAM' else 'CSARR' end",
            "intervenant": "case when p % 5 = 0 then '00' else lpad(cast(p % 32 as string), 2, '0') end",
            "ponderation_patient": "case when p % 47 = 0 then 'n/a' when p % 43 = 0 then '0' else cast(p_size as string) end",
            "debut": "case when p % 7 = 0 then null else cast(2018 + p % 6 as string) end",
            "mod_hw": "case when p % 2 = 0 then 'x' end", "mod_lj": "case when p % 3 = 1 then 'x' end",
            "mod_xh": "case when p % 4 = 1 then 'x' end", "mod_l3": "case when p % 5 = 1 then 'x' end",
        }
        return self.part.select(F.col("p").alias("line_no"), *[F.expr(v).alias(k) for k, v in cols.items()])

    @cached_property
    def transcoding_sheet(self) -> DataFrame:
        """One row per (act, staff, modality), as the published sheet has."""
        return self.part.groupBy(
            F.expr("concat('C', lpad(cast(p % 60 as string), 4, '0'))").alias("code_csar"),
            F.expr("lpad(cast(p % 32 as string), 2, '0')").alias("intervenant"),
            F.expr("case when p % 4 = 3 then null else cast(p % 4 as string) end").alias("acte_coll"),
        ).agg(F.max(F.expr("case when p % 59 = 0 then null else concat('ACT', lpad(cast(p * 7 % 300 as string), 4, '0')) end")).alias("code_csarr"))

    @cached_property
    def modality_sheet(self) -> DataFrame:
        """Time and place modalities (one small sheet)."""
        rows = [
            ("Temps", None, "0", None, None), ("Temps", "T0", "1", None, None), ("Temps", "T1", "5", None, None),
            ("Temps", "T2", "10", None, None), ("Temps", "T3", "20", None, None), ("Temps", "T4", "n/a", None, None),
            ("Lieu", "L1", None, "20", "10"), ("Lieu", "L2", None, "30", "sans objet"), ("Lieu", "L3", None, "5", None),
        ]
        return self.spark.createDataFrame(
            rows, "categorie string, modalite string, ponderation string, majoration_individuel string, majoration_collectif string"
        )

    @cached_property
    def modulator_sheet(self) -> DataFrame:
        rows = [("HW", "20", "10"), ("LJ", "15", "sans objet"), ("XH", "30", "12"), ("L3", "5", "2")]
        return self.spark.createDataFrame(rows, "code string, majoration_individuel string, majoration_collectif string")

    @cached_property
    def specialised(self) -> DataFrame:
        return self.weight_sheet.join(self.part, F.col("line_no") == F.col("p")).select(
            F.expr("concat(lpad(cast(p % 16 + 1 as string), 2, '0'), lpad(cast(p % 7 as string), 2, '0'))").alias("gn"),
            F.col("code").alias("code_acte"),
        ).distinct()

    @cached_property
    def score_tables(self) -> ScoreTables:
        return ScoreTables(
            weights=nom.act_weights(self.weight_sheet), modulators=nom.surcharge_rates(self.modulator_sheet, "code"),
            transcoding=nom.transcoding_detail(self.transcoding_sheet), time_weights=nom.time_weights(self.modality_sheet),
            place_surcharges=nom.place_surcharges(self.modality_sheet), specialised=self.specialised,
        )

    @cached_property
    def staff_labels(self) -> DataFrame:
        return self.raw("supplier").where("s_suppkey % 32 <> 7").groupBy(
            F.expr("lpad(cast(s_suppkey % 32 as string), 2, '0')").alias("code")
        ).agg(F.min("s_name").alias("libelle"))

    @cached_property
    def group_sheet(self) -> DataFrame:
        """Group codes of all five levels with labels; some long labels are blank."""
        codes = nom.group_levels(self.part.select(F.expr(gme("p")).alias("code_gme")))
        return codes.select(
            "kind", "code", F.expr("concat('c ', code)").alias("libelle_court"),
            F.expr("case when substring(code, 1, 2) = '05' then '' else concat('Lib ', code) end").alias("libelle_long"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        return nom.group_hierarchy(self.group_sheet)

    @cached_property
    def error_table(self) -> DataFrame:
        return self.raw("region").select(
            F.expr("cast(r_regionkey as string)").alias("code"), F.col("r_name").alias("libelle"),
            F.expr("case when r_regionkey % 2 = 0 then 'B' else 'N' end").alias("type"),
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self.part.where("p % 4 <> 0").groupBy(F.expr(diag("p")).alias("code")).agg(F.min("p_name").alias("libelle_complet"))

    @cached_property
    def diagnosis_nodes(self) -> DataFrame:
        """Chapters, blocks and categories (three characters; four for a third of the codes)."""
        codes = self.part.select("p", F.expr(diag("p")).alias("c")).where("c not like 'Q%'")
        def node(code: str, kind: str, parent: str, where: str = "true") -> DataFrame:
            return codes.where(where).select(F.expr(code).alias("code"), F.lit(kind).alias("kind"), F.expr(parent).alias("parent_code")).distinct()
        chapter = "concat('CH', cast((ascii(substring(c, 1, 1)) - 65) % 5 as string))"
        block = "concat(substring(c, 1, 2), 'X')"
        nodes = (
            node(chapter, "chapter", "cast(null as string)").unionByName(node(block, "block", chapter))
            .unionByName(node("substring(c, 1, 3)", "category", block))
            .unionByName(node("c", "category", "substring(c, 1, 3)", "p % 3 = 0"))
        )
        return nodes.withColumn("libelle", F.concat(F.lit("L "), "code"))

    # --- derived results used by several queries ----------------------------------------------

    @cached_property
    def weekly_value(self) -> DataFrame:
        from wardflow.operators.allocation import weekly_value

        return weekly_value(self.weeks, self.valuation, self.admin)

    @cached_property
    def whole_weekly_value(self) -> DataFrame:
        """The value of weeks without their units, for totals by establishment."""
        from wardflow.operators.allocation import weekly_value

        return weekly_value(self.weeks, self.valuation, self.admin, by_unit=False)

    @cached_property
    def daily(self) -> DataFrame:
        from wardflow.operators.allocation import days_of

        return days_of(self.weekly_value)

    @cached_property
    def stays(self) -> DataFrame:
        return self.weeks.select(*STAY).distinct()
