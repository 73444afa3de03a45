"""Presence and valuation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.bindings.oracle import part_of
from wardflow.bindings.registry import query
from wardflow.bindings.tables import Tables
from wardflow.operators import presence as pr
from wardflow.operators.allocation import billed_amounts, daily_value, presence_weighted, tag_cases, unit_shares
from wardflow.operators.crossgrain import match_other_source
from wardflow.plans import dashboard as dash
from wardflow.plans import valuation as val

P = ["finess_epmsi", "iso_year"]


def r(value: Column | str, digits: int = 2) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits)


def cents(value: Column | str, digits: int = 2) -> Column:
    """Exact decimal sums, rounded once."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits).cast("double")


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


@query("c2_present_days", """
select numero_unite_medicale, n_days, count(*) n from v_weeks group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.weeks.groupBy("numero_unite_medicale", "n_days").agg(F.count(F.lit(1)).alias("n"))


@query("c3_presence_days", """
select finess_epmsi, stay, cast("day" as varchar) "day", numero_unite_medicale from v_days""")
def _(t: Tables) -> DataFrame:
    days = pr.expand_days(t.weeks, "finess_epmsi", "stay", "numero_unite_medicale")
    return days.withColumn("day", text("day"))


@query("c5_days_per_campaign_year", """
select finess_epmsi, cast(sunday_year as int) sunday_year, cast(sum(n_days) as bigint) n_days, count(distinct stay) n_stays from v_weeks group by 1, 2""")
def _(t: Tables) -> DataFrame:
    per_stay = t.weeks.groupBy("finess_epmsi", "sunday_year", "stay").agg(F.sum("n_days").alias("d"))
    return per_stay.groupBy("finess_epmsi", "sunday_year").agg(F.sum("d").alias("n_days"), F.count(F.lit(1)).alias("n_stays"))


@query("c6_week_end", """
select numero_semaine, cast(any_value(sunday) as varchar) sunday, count(*) n from v_weeks group by 1""")
def _(t: Tables) -> DataFrame:
    return t.weeks.groupBy("numero_semaine").agg(text(F.min("sunday")).alias("sunday"), F.count(F.lit(1)).alias("n"))


@query("f11_last_presence", """
select finess_epmsi, stay, cast(max(sunday) as varchar) last_sunday from v_weeks group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.last_sunday.withColumn("last_sunday", text("last_sunday"))


@query("f3_last_unit", """
select finess_epmsi, stay, arg_max(numero_unite_medicale, line_no) last_unit, arg_max(numero_unite_medicale, week * 10000000 + line_no) last_unit_by_week from v_weeks group by 1, 2""")
def _(t: Tables) -> DataFrame:
    quirk = pr.last_unit(t.weeks, year_aware=False).withColumnRenamed("last_unit", "last_unit_by_week")
    return pr.last_unit(t.weeks).join(quirk, pr.STAY)


@query("r9_day_axis", """
select finess_epmsi, stay, cast("day" as varchar) "day", entries, unit, hosp from v_day_axis""")
def _(t: Tables) -> DataFrame:
    return pr.profile_days(pr.week_profile(t.weeks)).withColumns({"day": text("day"), "entries": F.col("entries").cast("bigint")})


@query("c31_stay_amount", """
select finess_epmsi, campagne, cast(sum(montant_br_sej) as double) montant, count(*) n from v_valuation group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.valuation.groupBy("finess_epmsi", "campagne").agg(F.sum("montant_br_sej").cast("double").alias("montant"), F.count(F.lit(1)).alias("n"))


@query("c32_official_rows", "select finess_epmsi, stay, campagne, numero_rha from v_official")
def _(t: Tables) -> DataFrame:
    from wardflow.functions.derive import official_amount_rows

    return t.valuation.where(official_amount_rows()).select("finess_epmsi", "stay", "campagne", "numero_rha")


@query("e15_billing_cases", """
select finess_epmsi, stay, campagne, numero_semaine, case when n_rows > 1 then 4 when n_camp = 1 then 2 else 1 end billing_case,
  cast(montant_br_sej as double) amount from v_billed""")
def _(t: Tables) -> DataFrame:
    return tag_cases(billed_amounts(t.valuation)).drop("n_rows").withColumn("amount", F.col("amount").cast("double"))


@query("e15_daily_value", """
select finess_epmsi, stay, campagne, billing_case, cast("day" as varchar) "day", count(*) entries, cast(round(sum(amount), 6) as double) "value" from v_daily group by 1, 2, 3, 4, 5""")
def _(t: Tables) -> DataFrame:
    return t.daily.select("finess_epmsi", "stay", "campagne", "billing_case", text("day").alias("day"), F.col("entries").cast("bigint").alias("entries"), cents("value", 6).alias("value"))


@query("e15_daily_value_of_two_files", """
select d.finess_epmsi, d.stay, campagne, billing_case, cast(d."day" as varchar) "day", coalesce(unit, '-') unit, cast(round(sum(amount), 6) as double) "value"
from v_daily d left join v_day_axis a on a.finess_epmsi = d.finess_epmsi and a.stay = d.stay and a."day" = d."day" and billing_case <> 3 group by all""")
def _(t: Tables) -> DataFrame:
    """The weekly records as three files whose lines are numbered anew in each; ties of the line are told apart by the file."""
    weeks = t.weeks.withColumns({"source_file": F.concat(F.lit("f"), "numero_unite_medicale"), "line_no": F.col("iso_year") * 100 + F.col("week")})
    daily = daily_value(weeks, t.valuation, t.admin)
    return daily.select("finess_epmsi", "stay", "campagne", "billing_case", text("day").alias("day"), F.coalesce("unit", F.lit("-")).alias("unit"), cents("value", 6).alias("value"))


@query("e15_daily_value_by_axis", """
select d.finess_epmsi, coalesce(unit, '-') unit, coalesce(hosp, '-') hosp, cast(round(sum(amount), 2) as double) "value", count(*) entries
from v_daily d left join v_day_axis a on a.finess_epmsi = d.finess_epmsi and a.stay = d.stay and a."day" = d."day" and billing_case <> 3 group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    none = F.lit("-")
    return t.daily.groupBy("finess_epmsi", F.coalesce("unit", none).alias("unit"), F.coalesce("hosp", none).alias("hosp")).agg(
        cents(F.sum("value")).alias("value"), F.sum("entries").alias("entries")
    )


@query("e16_value_per_year", """
select finess_epmsi, cast(year("day") as int) annee, cast(round(sum(amount), 2) as double) montant_br_pt from v_daily group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return val.value_per_year(t.whole_weekly_value).withColumn("montant_br_pt", cents("montant_br_pt"))


@query("e16_value_per_year_and_unit", """
select d.finess_epmsi, cast(year(d."day") as int) annee, coalesce(unit, '(vide)') unite, cast(round(sum(amount), 2) as double) montant_br_pt
from v_daily d left join v_day_axis a on a.finess_epmsi = d.finess_epmsi and a.stay = d.stay and a."day" = d."day" and billing_case <> 3 group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = t.weekly_value.withColumn("unite", F.coalesce("unit", F.lit("(vide)")))
    return val.value_per_year(rows, ["unite"]).withColumn("montant_br_pt", cents("montant_br_pt"))


@query("e17_value_in_period", """
select p.finess_epmsi, p.iso_year, cast(round(sum(amount), 2) as double) montant_br_pt from v_daily d join v_periods p on p.finess_epmsi = d.finess_epmsi and d."day" between p."start" and p."end" group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return val.value_in_period(t.whole_weekly_value, t.periods).withColumn("montant_br_pt", cents("montant_br_pt"))


@query("e18_campaign_amount", """
select finess_epmsi, campagne, cast(sum(montant_br_tot - coalesce(montant_br_trans, 0)) as double) montant from v_official where montant_br_tot is not null group by 1, 2""")
def _(t: Tables) -> DataFrame:
    return val.campaign_amount(t.valuation).withColumn("montant", F.col("montant").cast("double"))


_COMPARABLE = """
select finess_epmsi, iso_year, cast(coalesce(sum(montant_br_sej) filter (coalesce(nv_chain, 0) = 0 and coalesce(nv_attente_dts, 0) = 0 and coalesce(nv_nonfactam, 0) = 0), 0) as double) montant_br_tot,
  cast(sum(montant_br_sej) as double) montant_br_tot_sans_filtre,
  cast(sum(montant_br_sej) - coalesce(sum(montant_br_sej) filter (coalesce(nv_chain, 0) = 0 and coalesce(nv_attente_dts, 0) = 0 and coalesce(nv_nonfactam, 0) = 0), 0) as double) montant_br_non_fact
from v_comparable_all group by 1, 2"""


@query("e19_comparable_amount", _COMPARABLE)
def _(t: Tables) -> DataFrame:
    out = val.comparable_amount(t.valuation, t.weeks, t.periods)
    return out.select(*P, *[F.col(c).cast("double").alias(c) for c in out.columns if c.startswith("montant")])


@query("e20_amount_by_hospitalisation", """
select finess_epmsi, iso_year, type_hospitalisation, cast(sum(montant_br_sej) as double) montant from v_comparable group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return val.amount_by_hospitalisation(t.valuation, t.weeks, t.periods).withColumn("montant", F.col("montant").cast("double"))


@query("e21_unit_shares", "select finess_epmsi, stay, unite, round(share, 8) share from v_unit_share")
def _(t: Tables) -> DataFrame:
    return unit_shares(t.weeks, pr.last_unit(t.weeks)).drop("n", "n_stay").withColumn("share", r("share", 8))


@query("e21_amount_by_unit", f"""
select c.finess_epmsi, c.iso_year, unite, cast(round(sum({part_of("montant", "n_stay", "n")}), 2) as double) montant from (select finess_epmsi, iso_year, stay, sum(montant_br_sej) montant from v_comparable group by 1, 2, 3) c join v_unit_share s using (finess_epmsi, stay) group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return val.amount_by_unit(t.valuation, t.weeks, t.periods).withColumn("montant", cents("montant"))


@query("e22_supplements", """
select finess_epmsi, iso_year, cast(sum(coalesce(montant_br_trans, 0)) as double) transport, cast(sum(coalesce(montant_am_med, 0)) as double) molecules_onereuses,
  cast(sum(coalesce(montant_br_supp_cancero, 0)) as double) supp_cancero,
  cast(sum(coalesce(montant_br_trans, 0) + coalesce(montant_am_med, 0) + coalesce(montant_br_supp_cancero, 0)) as double) total from v_comparable group by 1, 2""")
def _(t: Tables) -> DataFrame:
    out = val.supplements(t.valuation, t.weeks, t.periods)
    return out.select(*P, *[F.col(c).cast("double").alias(c) for c in out.columns if c not in P])


@query("e23_unvalued_stays", """
with rows_ as (select v.*, case when coalesce(nv_chain, 0) <> 0 then 'nv_chain' when coalesce(nv_attente_dts, 0) <> 0 then 'nv_attente_dts' when coalesce(nv_nonfactam, 0) <> 0 then 'nv_nonfactam'
    when code_gme = '9096ZZ0' then 'erreur_groupage' else 'en_cours' end cause
  from v_valuation v join v_closed c on c.finess_epmsi = v.finess_epmsi and c.stay = v.stay and c.iso_year = v.campagne),
per_stay as (select finess_epmsi, stay, campagne iso_year, bool_or(coalesce(montant_br_sej <> 0, false)) paid, arg_min(cause, numero_rha) cause from rows_ group by 1, 2, 3)
select finess_epmsi, iso_year, cause, count(*) effectif,
  case cause when 'nv_chain' then 'Chaînage (NV_CHAIN)' when 'nv_attente_dts' then 'En attente de droits (NV_ATTENTE_DTS)' when 'nv_nonfactam' then 'Non facturable à l''AM (NV_NONFACTAM)'
    when 'erreur_groupage' then 'Erreur de groupage (GME 9096Z)' else 'Séjour en cours, pas encore clos (<90j)' end libelle,
  case cause when 'nv_chain' then 0 when 'nv_attente_dts' then 1 when 'nv_nonfactam' then 2 when 'erreur_groupage' then 3 else 4 end rang
from per_stay where not paid group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return val.unvalued_stays(t.valuation, t.weeks, t.periods)


_OPEN = """
open_ as (select distinct finess_epmsi, stay, iso_year from v_weeks w
  where not exists (select 1 from v_valuation v where v.finess_epmsi = w.finess_epmsi and v.stay = w.stay and montant_br_tot is not null)
    and not exists (select 1 from v_valuation v where v.finess_epmsi = w.finess_epmsi and v.stay = w.stay and (coalesce(nv_chain, 0) <> 0 or coalesce(nv_attente_dts, 0) <> 0 or coalesce(nv_nonfactam, 0) <> 0)))"""


@query("d7_clean_open_stays", f"with {_OPEN} select finess_epmsi, stay, iso_year from open_")
def _(t: Tables) -> DataFrame:
    return val.clean_open_stays(t.valuation, t.weeks)


@query("h4_stays_without_valuation", """
select finess_epmsi, stay from (select distinct finess_epmsi, stay from v_weeks) except select finess_epmsi, stay from v_valuation where montant_br_tot is not null""")
def _(t: Tables) -> DataFrame:
    return t.stays.subtract(t.valuation.where("montant_br_tot is not null").select("finess_epmsi", "stay"))


_PRICE = """
value_ as (select p.finess_epmsi, p.iso_year, sum(amount) v from v_daily d join v_periods p on p.finess_epmsi = d.finess_epmsi and d."day" between p."start" and p."end" group by 1, 2),
act_ as (select finess_epmsi, iso_year, count(distinct numero_admin_sejour) nb_ssr, count(*) nb_rhs, sum(n_days) nb_journees from v_in_period group by 1, 2)"""


def _activity(t: Tables) -> DataFrame:
    return dash.stay_activity(t.in_period, t.weeks)


@query("e24_open_stay_estimate", f"""
with {_OPEN}, {_PRICE}, days_ as (select o.finess_epmsi, o.iso_year, count(distinct o.stay) s, count(*) j from open_ o join v_periods p on p.finess_epmsi = o.finess_epmsi and p.iso_year = o.iso_year
  join v_days d on d.finess_epmsi = o.finess_epmsi and d.stay = o.stay and d."day" between p."start" and p."end" group by 1, 2)
select a.finess_epmsi, a.iso_year, coalesce(s, 0) nb_sejours, coalesce(j, 0) nb_journees, round(coalesce(j, 0) * coalesce(cast(v as double) / nullif(nb_journees, 0), 0), 2) montant
from act_ a left join value_ using (finess_epmsi, iso_year) left join days_ using (finess_epmsi, iso_year)""")
def _(t: Tables) -> DataFrame:
    value = val.value_in_period(t.whole_weekly_value, t.periods)
    price = _activity(t).join(value, P, "left").select(*P, F.try_divide(F.col("montant_br_pt").cast("double"), F.col("nb_journees")).alias("pmjt"))
    return val.open_stay_estimate(t.valuation, t.weeks, t.periods, price).withColumn("montant", r("montant"))


@query("e25_mean_prices", f"""
with {_PRICE}, amounts_ as ({_COMPARABLE})
select a.finess_epmsi, a.iso_year, cast(round(coalesce(v, 0), 2) as double) montant_br_pt, round(cast(coalesce(v, 0) as double) / nb_ssr, 4) pmct, round(cast(coalesce(v, 0) as double) / nb_rhs, 4) pmst,
  round(cast(coalesce(v, 0) as double) / nullif(nb_journees, 0), 4) pmjt, coalesce(montant_br_tot, 0.0) montant_br_tot, coalesce(montant_br_tot_sans_filtre, 0.0) montant_br_tot_sans_filtre, coalesce(montant_br_non_fact, 0.0) montant_br_non_fact
from act_ a left join value_ using (finess_epmsi, iso_year) left join amounts_ using (finess_epmsi, iso_year)""")
def _(t: Tables) -> DataFrame:
    out = val.mean_prices(val.value_in_period(t.whole_weekly_value, t.periods), _activity(t), val.comparable_amount(t.valuation, t.weeks, t.periods))
    return out.select(*P, cents("montant_br_pt").alias("montant_br_pt"), *[r(c, 4).alias(c) for c in ("pmct", "pmst", "pmjt")],
                      *[F.col(c).cast("double").alias(c) for c in out.columns if c.startswith("montant_br_tot") or c == "montant_br_non_fact"])


_MATCH = """
cand as (select *, case when numero_rha = '000' then null else cast(numero_semaine_htp as int) end wk from v_official),
w as (select finess_epmsi, stay, campagne, wk, min(numero_rha) rha from cand where wk is not null group by all),
y as (select finess_epmsi, stay, campagne, min(numero_rha) rha from cand group by all),
m as (select b.rhs_id, b.finess_epmsi, b.stay, b.iso_year, b.n_days, b.line_no, coalesce(w.rha, y.rha) rha from v_weeks b
  left join w on w.finess_epmsi = b.finess_epmsi and w.stay = b.stay and w.campagne = b.iso_year and w.wk = b.week
  left join y on y.finess_epmsi = b.finess_epmsi and y.stay = b.stay and y.campagne = b.iso_year)"""


def _matched(t: Tables) -> DataFrame:
    from wardflow.functions.derive import official_amount_rows

    other = t.valuation.where(official_amount_rows()).select(
        "finess_epmsi", "stay", "campagne", "numero_rha", "montant_br_sej",
        F.col("numero_semaine_htp").try_cast("int").alias("htp"),
    )
    base = t.weeks.select("rhs_id", "finess_epmsi", "stay", "iso_year", "week", "n_days", "line_no", "numero_unite_medicale", "source_file")
    return match_other_source(
        base, other, ["finess_epmsi", "stay"], "iso_year", "week", "campagne", "htp", ["numero_rha", "campagne"],
        ["numero_rha", "campagne", "montant_br_sej"],
    )


@query("d5_match_other_source", f"with {_MATCH} select rhs_id, rha o_numero_rha, rha is not null matched from m")
def _(t: Tables) -> DataFrame:
    return _matched(t).select("rhs_id", "o_numero_rha", "matched")


@query("e37_presence_weighted_amount", f"""
with {_MATCH}, o as (select m.*, montant_br_sej, sum(n_days) over g tot, max(line_no) over g last_no from m join v_official v on v.finess_epmsi = m.finess_epmsi and v.stay = m.stay and v.campagne = m.iso_year and v.numero_rha = m.rha
  window g as (partition by m.finess_epmsi, m.stay, m.iso_year, m.rha))
select rhs_id, round(cast(montant_br_sej as double) * case when tot > 0 then n_days / tot when line_no = last_no then 1 else 0 end, 4) allocated from o""")
def _(t: Tables) -> DataFrame:
    linked = _matched(t).where("matched").withColumn("amount", F.col("o_montant_br_sej").cast("double"))
    out = presence_weighted(linked, ["finess_epmsi", "stay", "o_campagne", "o_numero_rha"], "n_days", "amount", ["iso_year", "week", "line_no"])
    return out.select("rhs_id", r("allocated", 4).alias("allocated"))
