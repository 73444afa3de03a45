"""SQL text of the derived views, for checking results with an independent engine.

``with_views(body)`` prefixes a query with all views; unused ones cost nothing.
"""

from __future__ import annotations

VIEWS: list[tuple[str, str]] = []


def diag(x: str) -> str:
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({x} % 26 as int) + 1, 1) || lpad(cast({x} % 90 as varchar), 2, '0') || cast({x} % 10 as varchar)"


def gme(x: str) -> str:
    return (
        f"case when {x} % 23 = 0 then '9096ZZ0' else lpad(cast({x} % 16 + 1 as varchar), 2, '0') || lpad(cast({x} % 7 as varchar), 2, '0')"
        f" || substr('PSTUHIJKL', cast({x} % 9 as int) + 1, 1) || substr('ABC', cast(({x} % 5) % 3 as int) + 1, 1) || cast({x} % 3 as varchar) end"
    )


BIRTH = "strftime(date '1920-01-01' + cast(o_custkey * 37 % 36500 as int), '%Y-%m-%d')"
SEX = "case when o_custkey % 50 = 0 then '3' else cast(1 + o_custkey % 2 as varchar) end"
_DEPENDENCE = ["habillage_toilette", "deplacement", "alimentation", "continence", "comportement", "relation"]


def view(name: str, sql: str) -> None:
    VIEWS.append((name, sql))


def with_views(body: str) -> str:
    """The query with the views it needs (and theirs), in definition order."""
    import re

    wanted: set[str] = set()
    names = {n for n, _ in VIEWS}
    pending = [body]
    definitions = dict(VIEWS)
    while pending:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", pending.pop())):
            if word in names and word not in wanted:
                wanted.add(word)
                pending.append(definitions[word])
    chosen = [f"{n} AS ({q})" for n, q in VIEWS if n in wanted]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*chosen, body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*chosen, body[len("WITH "):]])
    return (f"WITH {', '.join(chosen)} " if chosen else "") + body


view("v_orders", """
select *, '68000000' || substr(o_orderpriority, 1, 1) finess_epmsi, lpad(cast(o_orderkey as varchar), 9, '0') numero_admin_sejour,
       strftime(o_orderdate, '%Y-%m-%d') order_day from orders""")
view("v_lines", """
select *, lpad(cast(l_orderkey as varchar), 9, '0') || '|' || lpad(cast(iw as varchar), 2, '0') || cast(iy as varchar) || '|' || l_returnflag rhs_id
from (select *, cast(l_shipdate as date) d, isoyear(l_shipdate) iy, week(l_shipdate) iw, isodow(l_shipdate) - 1 dow from lineitem)""")
view("v_records0", f"""
select l_orderkey, iy, iw, l_returnflag, rhs_id, max(l_partkey) pk,
  {', '.join(f"max(case when dow = {i} then '1' else '0' end) f{i}" for i in range(7))},
  count(*) filter (l_linestatus = 'O') n1_nb_das, count(*) filter (l_partkey % 8 < 4) n2_nb_csarr,
  count(*) filter (l_partkey % 8 in (4, 5)) n3_nb_csar, count(*) filter (l_partkey % 8 = 6) n4_nb_ccam
from v_lines group by 1, 2, 3, 4, 5""")
view("v_weeks", f"""
select rhs_id, finess_epmsi, numero_admin_sejour, cast(o_orderkey as varchar) stay, cast(iy as int) iso_year, cast(iw as int) AS week,
  lpad(cast(iw as varchar), 2, '0') || cast(iy as varchar) numero_semaine,
  f0 || f1 || f2 || f3 || f4 jours_hors_weekend, f5 || f6 jours_weekend, f0 || f1 || f2 || f3 || f4 || f5 || f6 flags,
  cast(f0 as int) + cast(f1 as int) + cast(f2 as int) + cast(f3 as int) + cast(f4 as int) + cast(f5 as int) + cast(f6 as int) n_days,
  monday, monday + 6 sunday, year(monday + 6) sunday_year, l_returnflag numero_unite_medicale, o_orderstatus, pk,
  case when pk % 101 = 0 then null else {gme('pk')} end code_gme,
  case when pk % 13 = 0 then 'E' when pk % 29 = 0 then 'F' end indicateur_erreur,
  lpad(cast(pk % 5 as varchar), 3, '0') code_retour_groupage,
  case when iy <= 1996 then 'M1B' when iy <= 1998 then 'M1C' else 'M1D' end version_format_rhs_groupe,
  {', '.join(f"case when (pk + {i}) % 11 = 0 then null else cast(1 + (pk + {i}) % 4 as varchar) end dependance_{n}" for i, n in enumerate(_DEPENDENCE))},
  order_day date_debut_sejour, order_day date_entree_um,
  case when o_orderstatus = 'F' and (o_orderkey + iw) % 4 = 0 then strftime(monday + 6, '%Y-%m-%d') end date_fin_sejour,
  {BIRTH} date_naissance, {SEX} sexe, lpad(cast(o_custkey * 7 % 99000 as varchar), 5, '0') code_postal_residence,
  case o_orderkey % 4 when 0 then '2' when 1 then '3' else '1' end type_hospitalisation,
  cast(6 + pk % 3 as varchar) mode_entree_um, {diag('pk')} manifestation_morbide_principale,
  case when pk % 3 = 0 then {diag('(pk + 5)')} end affection_etiologique,
  n1_nb_das, n2_nb_csarr, n3_nb_csar, n4_nb_ccam,
  iy * 1000 + iw * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end line_no
from (select *, make_date(iy, 1, 4) - cast(isodow(make_date(iy, 1, 4)) - 1 as int) + cast((iw - 1) * 7 as int) monday from v_records0)
join v_orders on l_orderkey = o_orderkey""")
view("v_das", f"""
select rhs_id, l_linenumber seq, case when l_partkey % 53 = 0 then null else {diag('l_partkey')} end code_das
from v_lines where l_linestatus = 'O'""")
view("v_csarr", """
select rhs_id, l_linenumber seq, 'ACT' || lpad(cast(l_partkey % 300 as varchar), 4, '0') code_principal,
  case l_suppkey % 6 when 0 then 'HW' when 1 then 'LJ' when 2 then 'XH' when 3 then 'L3' end code_modulateur_lieu,
  case when l_suppkey % 37 = 5 then null else lpad(cast(l_suppkey % 32 as varchar), 2, '0') end code_intervenant,
  cast(floor(l_quantity) as int) % 5 nombre_realisations, l_linenumber % 3 nombre_reel_patients, strftime(d, '%Y-%m-%d') date_realisation
from v_lines where l_partkey % 8 < 4""")
view("v_csar", """
select rhs_id, l_linenumber seq, 'C' || lpad(cast(l_partkey % 60 as varchar), 4, '0') code_principal,
  case l_suppkey % 5 when 0 then 'L1' when 1 then 'L2' when 2 then 'L3' end code_modulateur_lieu,
  case when l_linenumber % 6 = 5 then null else 'T' || cast(l_linenumber % 6 as varchar) end code_modulateur_temps,
  case l_suppkey % 8 when 0 then '80' when 1 then '81' else lpad(cast(l_suppkey % 32 as varchar), 2, '0') end code_intervenant,
  case when l_linenumber % 3 = 0 then null else l_linenumber % 2 end modalite_collective,
  cast(floor(l_quantity) as int) % 4 nombre_realisations, strftime(d, '%Y-%m-%d') date_realisation
from v_lines where l_partkey % 8 in (4, 5)""")
view("v_ccam", """
select rhs_id, l_linenumber seq, 'CCA' || lpad(cast(l_partkey % 90 as varchar), 4, '0') code_ccam,
  cast(floor(l_quantity) as int) % 3 nombre_realisations, strftime(d, '%Y-%m-%d') date_realisation
from v_lines where l_partkey % 8 = 6""")
view("v_admin", f"""
select finess_epmsi, numero_admin_sejour, cast(o_orderkey as varchar) stay,
  case when o_custkey % 97 = 0 then null else cast(o_custkey as varchar) end numero_ipp, {SEX} sexe_beneficiaire,
  {BIRTH} date_naissance_beneficiaire, order_day date_hospitalisation,
  case when o_orderkey % 31 = 0 then null else order_day end date_entree,
  case when o_orderstatus = 'O' then null else strftime(cast(o_orderdate as date) + cast(o_orderkey % 90 as int), '%Y-%m-%d') end date_sortie,
  case when o_orderkey % 41 = 0 then 'XXXX' when o_orderkey % 43 = 0 then null else lpad(cast(o_custkey as varchar), 13, '1') end numero_immatriculation_assure,
  cast(round(o_totalprice * 100) as bigint) montant_facturer_tm, o_orderkey line_no
from v_orders where o_orderkey % 29 <> 0""")
view("v_stay_weeks", """
select l_orderkey k, iy, iw, year(d + cast(6 - dow as int)) sy, sum(cast(l_extendedprice as decimal(18,2))) amt from v_lines group by 1, 2, 3, 4""")
view("v_span", "select k, max(sy) last_sy from v_stay_weeks group by k")
view("v_valuation0", """
select k, case when k % 10 = 0 then last_sy else sy end campagne, cast(iy as varchar) || lpad(cast(iw as varchar), 2, '0') numero_semaine,
  cast(iy as varchar) || lpad(cast(iw as varchar), 2, '0') numero_rha, lpad(cast(iw as varchar), 2, '0') numero_semaine_htp,
  'P' type_hospitalisation, cast(amt as decimal(18,2)) amt
from v_stay_weeks join v_span using (k) where k % 5 = 0
union all
select k, sy, cast(sy as varchar) || '01', '000', null, 'C', cast(sum(amt) as decimal(18,2)) from v_stay_weeks where k % 7 = 0 and k % 5 <> 0 group by k, sy
union all
select o_orderkey, coalesce(last_sy, year(o_orderdate)), cast(coalesce(last_sy, year(o_orderdate)) as varchar) || '01', '000', null, 'C', cast(o_totalprice as decimal(18,2))
from v_orders left join v_span on k = o_orderkey where (o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0) or k is null""")
view("v_valuation1", """
select v.*, finess_epmsi, o_orderstatus, case when k % 23 = 0 then cast(0 as decimal(18,2)) else amt end montant_br_gmt,
  case when k % 3 = 0 and k % 23 <> 0 then cast((k % 1000) * 0.25 as decimal(18,2)) end montant_br_gmth,
  case when k % 4 = 0 then cast((k % 200) * 0.5 as decimal(18,2)) end montant_br_trans,
  case when k % 6 = 0 then cast(15.5 as decimal(18,2)) end montant_am_med, case when k % 9 = 0 then cast(20.25 as decimal(18,2)) end montant_br_supp_cancero
from v_valuation0 v join v_orders on k = o_orderkey""")
view("v_valuation", f"""
select finess_epmsi, cast(k as varchar) numero_admin_sejour, cast(k as varchar) stay, cast(campagne as int) campagne, numero_semaine, numero_rha, numero_semaine_htp,
  type_hospitalisation, montant_br_gmt, montant_br_gmth, montant_br_trans, montant_am_med, montant_br_supp_cancero,
  montant_br_gmt + coalesce(montant_br_gmth, 0) montant_br_sej,
  case when k % 11 = 0 then null else montant_br_gmt + coalesce(montant_br_gmth, 0) + coalesce(montant_br_trans, 0) + coalesce(montant_am_med, 0) + coalesce(montant_br_supp_cancero, 0) end montant_br_tot,
  case when o_orderstatus = 'P' and k % 3 = 0 then 1 when k % 2 = 0 then 0 end nv_chain,
  case when k % 17 = 0 then 1 else 0 end nv_attente_dts, case when k % 19 = 0 then 1 end nv_nonfactam,
  case when k % 13 = 0 then '9096ZZ0' else {gme('k')} end code_gme
from v_valuation1""")
view("v_official", "select * from v_valuation where coalesce(nv_chain, 0) = 0 and coalesce(nv_attente_dts, 0) = 0 and coalesce(nv_nonfactam, 0) = 0")
view("v_year_weeks", "select finess_epmsi, iso_year, min(week) first_week, max(week) last_week from v_weeks group by 1, 2")
view("v_target", """
select finess_epmsi, month(make_date(iso_year, 1, 4) - cast(isodow(make_date(iso_year, 1, 4)) - 1 as int) + cast((last_week - 1) * 7 + 3 as int)) target_month
from (select *, row_number() over (partition by finess_epmsi order by iso_year desc) rn from v_year_weeks) where rn = 1""")
view("v_calendar", """
select cast(isoyear(t) as int) iso_year, cast(week(t) as int) AS week, month(t) mo, cast(t as date) - 3 monday, cast(t as date) + 3 sunday
from (select unnest(generate_series(date '1900-01-04', date '2100-12-30', interval 7 day)) t)""")
view("v_periods", """
select y.finess_epmsi, y.iso_year, 1 min_week, max(c.week) max_week, min(c1.monday) "start", max(c.sunday) "end", any_value(target_month) "month"
from v_year_weeks y join v_target using (finess_epmsi)
join v_calendar c on c.iso_year = y.iso_year and c.mo = target_month join v_calendar c1 on c1.iso_year = y.iso_year and c1.week = 1
where first_week <= 2 and year(c.monday + 3) = y.iso_year group by 1, 2""")
view("v_in_period", "select w.* from v_weeks w join v_periods p using (finess_epmsi, iso_year) where week <= max_week")
view("v_days", """
select w.finess_epmsi, stay, iso_year, week, sunday_year, numero_unite_medicale, type_hospitalisation, line_no, monday + cast(i as int) "day"
from v_weeks w, generate_series(0, 6) g(i) where substr(flags, cast(i as int) + 1, 1) = '1'""")
view("v_day_axis", """
select finess_epmsi, stay, "day", count(*) entries, arg_max(numero_unite_medicale, line_no) unit,
  arg_max(case type_hospitalisation when '3' then '2' else type_hospitalisation end, line_no) hosp from v_days group by 1, 2, 3""")
view("v_billed", """
select *, count(*) over (partition by finess_epmsi, stay, campagne) n_rows,
  (select count(distinct campagne) from v_official b where b.stay = a.stay and b.finess_epmsi = a.finess_epmsi and b.montant_br_sej <> 0) n_camp
from v_official a where montant_br_sej <> 0""")
def part_of(amount: str, n: str, k: str = "1") -> str:
    """SQL text of k nth parts of an amount in cents, rounded half up to 12 places in whole numbers."""
    u = f"((cast(round(({amount}) * 100) as hugeint) * {k} * 20000000000 + {n}) // (2 * {n}))"
    return f"cast(cast({u} // 1000000000000 as varchar) || '.' || lpad(cast({u} % 1000000000000 as varchar), 12, '0') as decimal(38,12))"


view("v_daily", f"""
select b.finess_epmsi, b.stay, b.campagne, case when n_rows > 1 then 4 when n_camp = 1 then 2 else 1 end billing_case, d."day",
  {part_of("b.montant_br_sej", "(case when n_rows > 1 then w.n when n_camp = 1 then s.n else c.n end)")} amount
from v_billed b join v_days d using (finess_epmsi, stay)
join (select finess_epmsi, stay, count(*) n from v_days group by 1, 2) s using (finess_epmsi, stay)
join (select finess_epmsi, stay, sunday_year, count(*) n from v_days group by 1, 2, 3) c on c.finess_epmsi = d.finess_epmsi and c.stay = d.stay and c.sunday_year = d.sunday_year
join (select finess_epmsi, stay, iso_year, week, count(*) n from v_days group by 1, 2, 3, 4) w on w.finess_epmsi = d.finess_epmsi and w.stay = d.stay and w.iso_year = d.iso_year and w.week = d.week
where case when n_rows > 1 then cast(substr(b.numero_semaine, 1, 4) as int) = d.iso_year and cast(substr(b.numero_semaine, 5, 2) as int) = d.week
           when n_camp = 1 then true else b.campagne = d.sunday_year end
union all
select b.finess_epmsi, b.stay, b.campagne, 3, cast(a.date_entree as date), cast(b.montant_br_sej as decimal(38,12))
from v_billed b join v_admin a using (finess_epmsi, stay)
where n_rows = 1 and n_camp = 1 and date_entree is not null and not exists (select 1 from v_days d where d.stay = b.stay and d.finess_epmsi = b.finess_epmsi)""")
view("v_last_week", "select finess_epmsi, stay, iso_year, max(week) last_week from v_weeks group by 1, 2, 3")
view("v_closed", "select l.* from v_last_week l join v_periods p using (finess_epmsi, iso_year) where last_week <= max_week")
view("v_comparable_all", """
select v.*, v.campagne iso_year from v_valuation v join v_closed c on c.finess_epmsi = v.finess_epmsi and c.stay = v.stay and c.iso_year = v.campagne
where montant_br_tot is not null""")
view("v_comparable", "select * from v_comparable_all where coalesce(nv_chain, 0) = 0 and coalesce(nv_attente_dts, 0) = 0 and coalesce(nv_nonfactam, 0) = 0")
view("v_weights", """
select p_partkey line_no, case when p_partkey % 3 = 0 then 'CCA' || lpad(cast(p_partkey % 90 as varchar), 4, '0') else 'ACT' || lpad(cast(p_partkey % 300 as varchar), 4, '0') end code,
  case when p_partkey % 3 = 0 then 'CCAM' else 'CSARR' end nomenclature, case when p_partkey % 5 = 0 then '00' else lpad(cast(p_partkey % 32 as varchar), 2, '0') end intervenant,
  case when p_partkey % 47 = 0 or p_partkey % 43 = 0 then 0.0 else cast(p_size as double) end ponderation, case when p_partkey % 7 = 0 then -1 else 2018 + p_partkey % 6 end debut,
  p_partkey % 2 = 0 mod_hw, p_partkey % 3 = 1 mod_lj, p_partkey % 4 = 1 mod_xh, p_partkey % 5 = 1 mod_l3 from part""")
view("v_weight_act", "select * from v_weights qualify row_number() over (partition by nomenclature, code order by debut desc, line_no desc) = 1")
view("v_weight_staff", "select * from v_weights where nomenclature = 'CSARR' qualify row_number() over (partition by code, intervenant order by debut desc, line_no desc) = 1")
view("v_transcoding", """
select 'C' || lpad(cast(p_partkey % 60 as varchar), 4, '0') code_csar, lpad(cast(p_partkey % 32 as varchar), 2, '0') intervenant,
  case when p_partkey % 4 = 3 then '0' else cast(p_partkey % 4 as varchar) end acte_coll,
  p_partkey % 4 = 3 blank, max(case when p_partkey % 59 = 0 then null else 'ACT' || lpad(cast(p_partkey * 7 % 300 as varchar), 4, '0') end) code_csarr
from part group by 1, 2, 3, 4""")
view("v_specialised", """
select distinct lpad(cast(p_partkey % 16 + 1 as varchar), 2, '0') || lpad(cast(p_partkey % 7 as varchar), 2, '0') gn, code code_acte from part join v_weights on line_no = p_partkey""")
view("v_staff_labels", "select lpad(cast(s_suppkey % 32 as varchar), 2, '0') code, min(s_name) libelle from supplier where s_suppkey % 32 <> 7 group by 1")
view("v_group_levels", f"""
select distinct kind, substr(c, 1, n) code from (select {gme('p_partkey')} c from part), (values ('CM', 2), ('GN', 4), ('GR', 5), ('GL', 6), ('GME', 7)) t(kind, n)""")
view("v_groups", """
select kind, code, case kind when 'CM' then null when 'GN' then substr(code, 1, 2) when 'GR' then substr(code, 1, 4) when 'GL' then substr(code, 1, 5) else substr(code, 1, 6) end parent_code,
  'c ' || code libelle_court, case when substr(code, 1, 2) = '05' then '' else 'Lib ' || code end libelle_long from v_group_levels""")
view("v_diagnoses", f"select {diag('p_partkey')} code, min(p_name) libelle_complet from part where p_partkey % 4 <> 0 group by 1")
view("v_part_codes", f"select p_partkey p, {diag('p_partkey')} c from part where {diag('p_partkey')} not like 'Q%'")
view("v_nodes", """
select distinct 'CH' || cast((ascii(c) - 65) % 5 as varchar) code, 'chapter' kind, cast(null as varchar) parent_code from v_part_codes
union all select distinct substr(c, 1, 2) || 'X', 'block', 'CH' || cast((ascii(c) - 65) % 5 as varchar) from v_part_codes
union all select distinct substr(c, 1, 3), 'category', substr(c, 1, 2) || 'X' from v_part_codes
union all select distinct c, 'category', substr(c, 1, 3) from v_part_codes where p % 3 = 0""")
view("v_stay_code", """
select finess_epmsi, iso_year, stay, arg_max(code_gme, week * 10000000 + line_no) code from v_in_period where code_gme is not null group by 1, 2, 3""")
view("v_unit_share", """
select finess_epmsi, stay, unit unite, sum(entries) n, sum(sum(entries)) over (partition by finess_epmsi, stay) n_stay, sum(entries) / sum(sum(entries)) over (partition by finess_epmsi, stay) share from v_day_axis group by 1, 2, 3
union all
select finess_epmsi, stay, arg_max(numero_unite_medicale, line_no), 1, 1, 1.0 from v_weeks w
where not exists (select 1 from v_days d where d.stay = w.stay and d.finess_epmsi = w.finess_epmsi) group by 1, 2""")
view("v_axis", """
select *, 'unit' axis, numero_unite_medicale axis_value from v_in_period where coalesce(trim(numero_unite_medicale), '') <> ''
union all select *, 'hosp', case type_hospitalisation when '3' then '2' else type_hospitalisation end from v_in_period where coalesce(trim(type_hospitalisation), '') <> ''
union all select v_in_period.*, 'group', g.name from v_in_period join (values ('court', 'A'), ('court', 'N'), ('retour', 'R'), ('retour', 'N')) g(name, u) on g.u = numero_unite_medicale""")
view("v_axis_stay_code", """
select finess_epmsi, iso_year, axis, axis_value, stay, arg_max(code_gme, week * 10000000 + line_no) code from v_axis where code_gme is not null group by all""")


def by_axis(sql: str) -> str:
    """SQL of a section by (finess_epmsi, iso_year) as that by axis and axis value too; stays' amounts stay as they are."""
    import re

    amounts = ["select finess_epmsi, iso_year, stay, sum(montant_br_sej) m from v_comparable group by 1, 2, 3", "left join v using (finess_epmsi, iso_year, stay)",
               "(select finess_epmsi, stay, max(sunday) last_sunday from v_weeks group by 1, 2)"]
    for i, text in enumerate(amounts):
        sql = sql.replace(text, f"@{i}@")
    sql = sql.replace("v_in_period", "v_axis").replace("v_stay_code", "v_axis_stay_code")
    sql = re.sub(r"\b((?:\w+\.)?)finess_epmsi, ((?:\w+\.)?)iso_year\b", r"\1finess_epmsi, \2iso_year, \2axis, \2axis_value", sql)
    sql = re.sub(r"finess_epmsi, code\b", "finess_epmsi, axis, axis_value, code", sql)
    sql = sql.replace("partition by finess_epmsi order", "partition by finess_epmsi, axis, axis_value order").replace("k.stay = s.stay", "k.stay = s.stay and k.axis = s.axis and k.axis_value = s.axis_value")
    sql = re.sub(r"group by \d(?:, \d)*", lambda m: f"{m[0]}, {int(m[0][-1]) + 1}, {int(m[0][-1]) + 2}", sql)
    for i, text in enumerate(amounts):
        sql = sql.replace(f"@{i}@", text)
    return sql
