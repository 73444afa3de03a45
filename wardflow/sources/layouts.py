"""Layouts of the fixed-width and delimited transmission files.

A layout is plain text: one ``name first-last type`` entry per field (positions 1-based, inclusive;
types A text, N integer, D date DDMMYYYY). Older record versions are the current layout plus what
changed, so a version is a short rule and not another table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Field:
    name: str
    start: int
    end: int
    kind: str

    @property
    def width(self) -> int:
        return self.end - self.start + 1


@dataclass(frozen=True)
class Block:
    name: str
    counter: str
    width: int
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Layout:
    version: str
    fields: tuple[Field, ...]
    blocks: tuple[Block, ...]

    @property
    def fixed_length(self) -> int:
        return max(f.end for f in self.fields)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class Family:
    """All versions of one file family and where the version code is found."""

    name: str
    version_start: int
    version_end: int
    key: tuple[str, ...]
    link_fields: tuple[str, ...]
    layouts: tuple[Layout, ...]

    @property
    def versions(self) -> list[str]:
        return [layout.version for layout in self.layouts]

    def fields(self) -> list[tuple[str, str]]:
        """(name, kind) over all versions, first definition first."""
        seen: dict[str, str] = {}
        for layout in self.layouts:
            for f in layout.fields:
                seen.setdefault(f.name, f.kind)
        return list(seen.items())

    def blocks(self) -> list[tuple[str, list[tuple[str, str]]]]:
        """(block, its fields) over all versions."""
        seen: dict[str, dict[str, str]] = {}
        for layout in self.layouts:
            for block in layout.blocks:
                fields = seen.setdefault(block.name, {})
                for f in block.fields:
                    fields.setdefault(f.name, f.kind)
        return [(name, list(fields.items())) for name, fields in seen.items()]


def _fields(text: str) -> tuple[Field, ...]:
    out = []
    for entry in text.split():
        name, span, kind = entry.split(":")
        first, _, last = span.partition("-")
        out.append(Field(name, int(first), int(last or first), kind))
    return tuple(out)


def _shifted(fields: tuple[Field, ...], after: str, by: int) -> tuple[Field, ...]:
    """Fields following ``after`` moved by ``by`` positions."""
    pivot = next(f for f in fields if f.name == after).start
    return tuple(replace(f, start=f.start + by, end=f.end + by) if f.start > pivot else f for f in fields)


# Weekly stay record, version M1D, and its repeated blocks.
_WEEKLY = _fields("""
filler_1:1-10:A version_format_rhs_groupe:11-13:A finess_epmsi:14-22:A version_format_rhs:23-25:A
numero_sejour_smr:26-32:A numero_admin_sejour:33-52:A version_classification:53-54:A
code_gme:55-61:A code_retour_groupage:62-64:A indicateur_erreur:65:A
date_debut_sejour:66-73:D date_fin_sejour:74-81:D date_naissance:82-89:D sexe:90:A
code_postal_residence:91-95:A type_hospitalisation:96:A date_entree_um:97-104:D mode_entree_um:105:A
provenance:106:A date_sortie_um:107-114:D mode_sortie:115:A destination:116:A
numero_semaine:117-122:A jours_hors_weekend:123-127:A jours_weekend:128-129:A
numero_unite_medicale:130-133:A type_autorisation_um:134-136:A
date_intervention_chirurgicale:137-144:D filler_2:145-152:A
manifestation_morbide_principale:153-160:A affection_etiologique:161-168:A
dependance_habillage_toilette:169:A dependance_deplacement:170:A dependance_alimentation:171:A
dependance_continence:172:A dependance_comportement:173:A dependance_relation:174:A
n1_nb_das:175-176:N n2_nb_csarr:177-179:N n3_nb_csar:180-182:N n4_nb_ccam:183-184:N
poursuite_projet_therapeutique:185:A filler_3:186:A lits_places_dedies:187-188:A
type_unite_specifique:189-190:A
""")
_DAS = Block("das", "n1_nb_das", 8, _fields("code_das:1-8:A"))
_CSARR = Block("csarr", "n2_nb_csarr", 35, _fields("""
code_principal:1-7:A code_suppl_appareillage:8-10:A code_modulateur_lieu:11-12:A
code_modulateur_patient:13-14:A code_modulateur_technicite:15-16:A code_intervenant:17-18:A
module_niveau_technicite:19:A nombre_realisations:20-21:N date_realisation:22-29:D
nombre_reel_patients:30-31:N nombre_intervenants:32-33:N extension_documentaire:34-35:A
"""))
_CSAR = Block("csar", "n3_nb_csar", 30, _fields("""
code_principal:1-5:A code_modulateur_lieu:6-7:A code_modulateur_temps:8-9:A
code_modulateur_technicite:10-11:A module_niveau_technicite:12:A code_intervenant:13-14:A
modalite_collective:15:N modalite_pluriprofessionnelle:16:N nombre_realisations:17-18:N
date_realisation:19-26:D extension_documentaire:27-28:A filler:29-30:A
"""))
_CCAM = Block("ccam", "n4_nb_ccam", 23, _fields("""
date_realisation:1-8:D code_ccam:9-15:A extension_pmsi:16-18:A code_phase:19:A code_activite:20:A
extension_documentaire:21:A nombre_realisations:22-23:N
"""))

_M1D = Layout("M1D", _WEEKLY, (_DAS, _CSARR, _CSAR, _CCAM))
# M1C: no third counter and no CSAR block, so what follows the second counter is 3 earlier.
_M1C_FIELDS = tuple(f for f in _shifted(_WEEKLY, "n3_nb_csar", -3) if f.name != "n3_nb_csar")
_M1C = Layout("M1C", _M1C_FIELDS, (_DAS, _CSARR, _CCAM))
# M1B: as M1C with a six-character group code.
_M1B_FIELDS = tuple(
    replace(f, end=f.end - 1) if f.name == "code_gme" else f for f in _shifted(_M1C_FIELDS, "code_gme", -1)
)
_M1B = Layout("M1B", _M1B_FIELDS, (_DAS, _CSARR, _CCAM))

WEEKLY = Family(
    "rhs_groupe", 11, 13,
    key=("finess_epmsi", "numero_admin_sejour", "numero_semaine", "numero_unite_medicale", "date_entree_um"),
    link_fields=("finess_epmsi", "numero_admin_sejour", "numero_semaine", "numero_unite_medicale"),
    layouts=(_M1D, _M1C, _M1B),
)

# Administrative stay record, version V016, and its repeated block.
_ADMIN = _fields("""
numero_immatriculation_assure:1-13:A cle_immatriculation:14-15:A code_grand_regime:16-17:A
code_gestion:18-19:A date_naissance_beneficiaire:20-27:D sexe_beneficiaire:28:A
numero_admin_sejour:29-48:A version_format_vid_hosp:49-52:A finess_epmsi:53-61:A
numero_immatriculation_individuel:62-74:A cle_immatriculation_individuel:75-76:A
justification_exoneration_tm:77:A code_prise_en_charge_forfait_journalier:78:A
nature_assurance:79-80:A type_contrat:81-82:A sejour_facturable_am:83:A
motif_non_facturation_am:84:A facturation_18e:85:A nombre_venues_facture:86-89:A
montant_facturer_tm:90-99:N montant_facturer_fj:100-109:N
montant_total_sejour_remboursable_amo:110-119:N montant_majoration_parcours_soins:120-123:N
montant_base_remboursement:124-133:N taux_remboursement:134-138:A patient_beneficiaire_cmu:139:A
numero_admin_sejour_mere:140-159:A hospit_nouveau_ne_avec_mere:160:A
hospit_prelevement_organes:161:A date_hospitalisation:162-169:D
montant_total_sejour_remboursable_amc:170-179:N code_participation_assure:180:A
numero_entree:181-189:A rang_naissance:190:A rang_beneficiaire:191-193:A
numero_caisse_gestionnaire:194-196:A numero_centre_gestionnaire:197-200:A filler_1:201-230:A
confirmation_soins_urgents:231:A numero_at_ou_date_accident:232-240:A
numero_organisme_complementaire:241-250:A nature_piece_justificative_droits:251:A
prise_en_charge_etablie_le:252-259:D attestation_droits_valable_a_compter_du:260-267:D
delivree_par:268-270:A regime_prestation_assure:271-273:A top_eclatement_flux:274:A
date_entree:275-282:D date_sortie:283-290:D montant_total_sejour_facture_patient:291-298:A
rejet_amo:299:A date_facturation_amo:300-307:D date_facturation_amc:308-315:D
date_facturation_patient:316-323:D date_paiement_amo:324-331:D date_paiement_amc:332-339:D
date_paiement_patient:340-347:D statut_ft_amo:348:A statut_ft_amc:349:A statut_ft_patient:350:A
pays_assurance_sociale:351-353:A numero_ipp:354-373:A ins:374-388:A art51:389:A
complement_numero_titre_recette:390-395:A top_declaration_medecin_traitant:396:A
nom_medecin_traitant:397-421:A prenom_medecin_traitant:422-436:A indicateur_parcours_soins:437:A
cmuc_gestion_unique:438:A etablissement_transfert:439-452:A etablissement_retour:453-466:A
nombre_disciplines_prestations:467-470:N
""")
_DMT_FIELDS = _fields("""
discipline_prestations:1-3:A mode_traitement:4-5:A date_debut_sejour_dmt:6-13:D
date_fin_sejour_dmt:14-21:D quantite:22-24:N prix_unitaire:25-31:N base_remboursement:32-39:N
taux_applicable_prestation:40-42:A montant_remboursable_caisse:43-50:N
""")
_DMT = Block("dmt", "nombre_disciplines_prestations", 50, _DMT_FIELDS)
_V016 = Layout("V016", _ADMIN, (_DMT,))
# V015: the block counter has two characters. V014: moreover no quantity in the block.
_V015_FIELDS = tuple(
    replace(f, end=f.end - 2) if f.name == "nombre_disciplines_prestations" else f for f in _ADMIN
)
_V015 = Layout("V015", _V015_FIELDS, (_DMT,))
_V014 = Layout("V014", _V015_FIELDS, (Block(
    "dmt", "nombre_disciplines_prestations", 47,
    tuple(f for f in _shifted(_DMT_FIELDS, "quantite", -3) if f.name != "quantite"),
),))

ADMIN = Family(
    "vid_hosp", 49, 52,
    key=("finess_epmsi", "numero_admin_sejour"),
    link_fields=("finess_epmsi", "numero_admin_sejour"),
    layouts=(_V016, _V015, _V014),
)

FAMILIES = {WEEKLY.name: WEEKLY, ADMIN.name: ADMIN}


@dataclass(frozen=True)
class CsvColumn:
    name: str
    aliases: tuple[str, ...]
    kind: str


def _columns(text: str) -> tuple[CsvColumn, ...]:
    out = []
    for entry in text.split():
        name, header, kind = entry.split(":")
        out.append(CsvColumn(name, tuple(header.split(",")), kind))
    return tuple(out)


# Per-stay valuation file, ``column:HEADER:type`` (A text, I integer, R real).
# NUMSEMAINE occurs twice: the first is the year-week code, the second the part-time week.
VALUATION = _columns("""
finess_epmsi:FINESS:A numero_admin_sejour:NUMADMIN:A numero_semaine:NUMSEMAINE:A
numero_entree_sejour:NUMSEJOURSMR,NUMENTREE:A numero_sequence_ssr:SEQSSR:A numero_rha:NUMRHS:A
classe_age:CAGE:I type_hospitalisation:HOSP:A version_classification:VCLASS:A type_um:TYPE_UM:A
indicateur_valorisation:VALO:I type_generation_rha:TYPE_RHA_AUTO:A numero_semaine_htp:NUMSEMAINE:A
nv_cm90:NV_CM90:I nv_nonclos:NV_NONCLOS:I nv_pie:NV_PIE:I nv_chain:NV_CHAIN:I
nv_varano:NV_VARANO:I nv_attente_dts:NV_ATTENTE_DTS:I nv_nonfactam:NV_NONFACTAM:I
nv_article51:NV_ARTICLE51:I nv_telereadapt:NV_TELEREADAPT:I nv_evcepr:NV_EVCEPR:I
nv_gmt9999:NV_GMT9999:I nv_horsperiode:NV_HORSPERIODE:I
nv_nb_supp_trans_st4:NV_NB_SUPP_TRANS_ST4:I nv_nb_supp_trans_st5:NV_NB_SUPP_TRANS_ST5:I
nv_nb_supp_trans_st6:NV_NB_SUPP_TRANS_ST6:I nv_nb_med:NV_NB_MED:I cas_30j:CAS30J:A
mode_entree:MODEENTREE:A mode_sortie:MODESORTIE:A type_suite:TYPE_SUITE:A coeff_geo:COEFFGEO:R
coeff_spe:COEFFSPE:R coeff_segur:COEFFSEGUR:R coeff_reprise:COEFFREPRISE:R coeff_prud:COEFFPRUD:R
taux_remb:TXREMB:R taux_remb_attente:TXREMB_ATT:I montant_fj_tot:MNT_FJ_TOT:R montant_tm:MNT_TM:R
montant_tmf:MNT_TMF:R code_gme:GME:A libelle_gme:GMELIB:A code_gn:GN:A libelle_gn:GNLIB:A
code_gr:GR:A libelle_gr:GRLIB:A niveau_lourdeur:NL:A score_rr:SCORERR:R score_rr_spe:SCORERR_SPE:R
code_gmt:GMT:A zone_valorisation:ZV:A nb_jours_valorises_gmt:NBJV_GMT:I nb_supplements:NB_SUPP:I
montant_br_gmt:MNT_BR_GMT:R montant_br_prud_gmt:MNT_BR_PRUD_GMT:R montant_fj_gmt:MNT_FJ_GMT:R
montant_am_gmt:MNT_AM_GMT:R code_gmth:GMTH:A nb_jours_valorises_gmth:NBJV_GMTH:I
montant_br_gmth:MNT_BR_GMTH:R montant_br_prud_gmth:MNT_BR_PRUD_GMTH:R montant_fj_gmth:MNT_FJ_GMTH:R
montant_am_gmth:MNT_AM_GMTH:R nb_supp_cancero:NBSUPP_CANCERO:I
montant_br_supp_cancero:MNT_BR_SUPP_CANCERO:R
montant_br_prud_supp_cancero:MNT_BR_PRUD_SUPP_CANCERO:R
montant_am_supp_cancero:MNT_AM_SUPP_CANCERO:R nb_supp_trans_st4:NBSUPP_TRANS_ST4:I
nb_supp_trans_st5:NBSUPP_TRANS_ST5:I nb_supp_trans_st6:NBSUPP_TRANS_ST6:I
montant_br_trans:MNT_BR_TRANS:R montant_br_prud_trans:MNT_BR_PRUD_TRANS:R
montant_am_trans:MNT_AM_TRANS:R montant_am_med:MNT_AM_MED:R montant_br_tot:MNT_BR_TOT:R
montant_br_prud_tot:MNT_BR_PRUD_TOT:R montant_am_tot:MNT_AM_TOT:R reste_a_charge_detenu:RAC_DETENU:R
""")
VALUATION_KEY = ("finess_epmsi", "numero_admin_sejour", "campagne", "numero_rha")

# Tariff grid, ``column=header=type``, one entry per line.
TARIFF = tuple(
    CsvColumn(name, (header,), kind)
    for name, header, kind in (
        line.split("=") for line in """\
annee=ANNEE=I
sp=SP=I
code_gmt=GMT=A
code_gme=GME=A
libelle=LIBELLE=A
debut_zone_forfaitaire=Debut de zone forfaitaire (DZF)=R
fin_zone_forfaitaire=Fin de zone Forfaitaire (FZF)=R
tarif_zone_basse=Tarif de la zone basse (TZB)=R
supplement_zone_basse=Supplement de la zone basse (SZB)=R
tarif_zone_forfaitaire=Tarif de la zone Forfaitaire (TZF)=R
supplement_zone_haute=Supplement de la Zone Haute (SZH)=R
date_debut=DDEB=A
date_fin=DFIN=A
tarif_zone_forfaitaire_p2=Tarif de la Zone Forfaitaire - Période 2 (TZF2)=R
tarif_zone_forfaitaire_p3=Tarif de la Zone Forfaitaire - Période 3 (TZF3)=R""".splitlines()
    )
)
TARIFF_KEY = ("feuille_source", "code_gmt", "code_gme", "date_debut")
