"""Derived columns of the stay model: keys, presence, ages, code parts, labels and predicates."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "(vide)"
NO_MATCH = "(sans correspondance)"

# Code labels of the coded record fields.
LABELS: dict[str, dict[str, str]] = {
    "sexe": {"1": "Homme", "2": "Femme", "3": "Indéterminé"},
    "type_hospitalisation": {
        "1": "Complète", "2": "Partielle de jour", "3": "Partielle de nuit", "4": "Séances",
    },
    "type_hospitalisation_valo": {"C": "Complète", "P": "Temps partiel"},
    "mode_entree_um": {
        "6": "Mutation", "7": "Transfert définitif", "0": "Transfert provisoire", "8": "Domicile",
    },
    "mode_sortie": {
        "6": "Mutation", "7": "Transfert définitif", "0": "Transfert provisoire", "8": "Domicile",
        "9": "Décès",
    },
    "provenance": {
        "1": "MCO", "2": "SMR", "3": "SLD", "4": "Psychiatrie", "5": "Urgences (autre ES)",
        "6": "HAD", "7": "Structure d'hébergement médicosociale", "U": "Urgences (au sein de l'ES)",
    },
    "destination": {
        "1": "MCO", "2": "SMR", "3": "SLD", "4": "Psychiatrie", "6": "HAD",
        "7": "Structure d'hébergement médicosociale",
    },
    "gr": {
        "P": "Réadaptation pédiatrique (HC)", "S": "Réadaptation spécialisée importante (HC)",
        "T": "Réadaptation globale importante (HC)", "U": "Réadaptation autre (HC)",
        "H": "Réadaptation pédiatrique (HTP)", "I": "Réadaptation très intense (HTP)",
        "J": "Réadaptation intense (HTP)", "K": "Réadaptation modérée (HTP)",
        "L": "Réadaptation indifférenciée (HTP)",
    },
}

# Structure buckets of the group code, in display order.
STRUCTURE_CODES = {
    "gr": {
        "P": "Pédiatrique (HC)", "S": "Spécialisée (HC)", "T": "Globale (HC)", "U": "Autre (HC)",
        "H": "Pédiatrique (HTP)", "I": "Très intensive (HTP)", "J": "Intensive (HTP)",
        "K": "Modérée (HTP)", "L": "Indifférenciée (HTP)",
    },
    "gl": {"A": "Niveau A", "B": "Niveau B", "C": "Niveau C"},
    "sev": {"0": "HTP", "1": "HC sans sévérité", "2": "HC avec sévérité"},
}
STRUCTURE_POSITION = {"gr": 5, "gl": 6, "sev": 7}
STRUCTURE_ERROR = ("ERR", "Erreur de groupage")

# The day (2) and night (3) part-time types count as one; valuation files use C/P.
HOSPITALISATION_GROUP = {"1": "1", "2": "2", "3": "2"}
HOSPITALISATION_TO_VALUATION = {"1": "C", "2": "P", "3": "P"}


def blank_to_null(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def stay_key(raw: Column) -> Column:
    """Stay number without leading zeros, an all-zero one being ``0``; letters are kept, NULL stays NULL."""
    stripped = F.regexp_replace(F.trim(raw.cast("string")), "^0+", "")
    return F.when(raw.isNotNull(), F.coalesce(F.nullif(stripped, F.lit("")), F.lit("0")))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed code map; NULL for an unknown code."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def code_label(family: str, code: Column) -> Column:
    """Label of a coded field, NULL for an unlisted code."""
    return lookup(LABELS[family], code)


def hospitalisation_group(code: Column) -> Column:
    """Hospitalisation type with night part-time merged into day part-time."""
    return F.coalesce(lookup(HOSPITALISATION_GROUP, code), code)


def day_flags(weekdays: Column, weekend: Column) -> Column:
    """The seven presence characters, Monday first."""
    return F.concat(F.coalesce(weekdays, F.lit("")), F.coalesce(weekend, F.lit("")))


def present_days(flags: Column) -> Column:
    """Number of present days in a flag string."""
    return F.length(F.regexp_replace(flags, "[^1]", ""))


def sum_of_known(*items: Column) -> Column:
    """Sum of the numeric items, NULL when none is known."""
    numbers = [i.try_cast("double") for i in items]
    total = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in numbers])
    return F.when(F.coalesce(*numbers).isNotNull(), total)


def age_years(birth: Column, ref: Column) -> Column:
    """Age in years of 365.25 days."""
    return F.datediff(ref, birth) / F.lit(365.25)


def age_band(age: Column) -> Column:
    """Age band label; ``Inconnu`` without an age."""
    # Upper bounds and labels of the bands.
    bands = [(18, "< 18 ans"), (45, "18-44 ans"), (65, "45-64 ans"), (75, "65-74 ans"), (85, "75-84 ans")]
    out = F.when(age.isNull(), F.lit("Inconnu"))
    for bound, label in bands:
        out = out.when(age < bound, F.lit(label))
    return out.otherwise(F.lit("85 ans et +"))


def department(postcode: Column) -> Column:
    """Department of a postcode: two characters, three overseas (97/98)."""
    overseas = postcode.startswith("97") | postcode.startswith("98")
    prefix = F.when(overseas, F.substring(postcode, 1, 3)).otherwise(F.substring(postcode, 1, 2))
    return F.when(F.length(postcode) >= 2, prefix)


def yes_no(flag: Column) -> Column:
    """Oui / Non of a 1/0 flag; any other value as text."""
    text = F.nullif(flag.cast("string"), F.lit(""))
    number = text.try_cast("double")
    return F.when(number == 1, F.lit("Oui")).when(number == 0, F.lit("Non")).otherwise(text)


def shown(code: Column, label: Column | None = None, mode: str = "libelle", matched: Column | None = None) -> Column:
    """Display value of a dimension.

    ``mode`` is ``code``, ``libelle`` or ``both``; a blank code shows as ``(vide)`` and, when
    ``matched`` is false, the row of the other source is missing altogether.
    """
    code_text = F.coalesce(F.nullif(code.cast("string"), F.lit("")), F.lit(EMPTY))
    out = code_text
    if label is not None and mode != "code":
        label_text = F.nullif(label.cast("string"), F.lit(""))
        if mode == "both":
            out = F.when(label_text.isNotNull(), F.concat(code_text, F.lit(" — "), label_text)).otherwise(code_text)
        else:
            out = F.coalesce(label_text, code_text)
    if matched is not None:
        out = F.when(F.coalesce(matched, F.lit(False)), out).otherwise(F.lit(NO_MATCH))
    return out


def group_parts(code: Column) -> dict[str, Column]:
    """Parts of a seven-character group code: cumulated CM and GN, single GR, GL and severity."""
    def char(position: int) -> Column:
        return F.nullif(F.substring(code, position, 1), F.lit(""))
    return {
        "cm": F.substring(code, 1, 2),
        "gn": F.substring(code, 1, 4),
        "gr": char(5),
        "gl": char(6),
        "severite": char(7),
    }


def structure_bucket(code: Column, block: str) -> Column:
    """Bucket of a group code in block ``gr``, ``gl`` or ``sev``; ``ERR`` for a grouping error."""
    error = F.lit(STRUCTURE_ERROR[0])
    gr = F.substring(code, STRUCTURE_POSITION["gr"], 1)
    part = F.substring(code, STRUCTURE_POSITION[block], 1)
    known = gr.isin(*STRUCTURE_CODES["gr"]) & part.isin(*STRUCTURE_CODES[block])
    return F.when(known, part).otherwise(error)


def structure_label(block: str, bucket: Column) -> Column:
    """Label of a structure bucket."""
    return F.coalesce(lookup(STRUCTURE_CODES[block], bucket), F.lit(STRUCTURE_ERROR[1]))


def error_code(code: Column) -> Column:
    """Grouping-error code without leading zeros when it starts with a digit."""
    digits = F.regexp_extract(code, "^[0-9]+", 0)
    return F.when(code.rlike("^[0-9]"), digits.try_cast("bigint").cast("string")).otherwise(code)


def official_amount_rows() -> Column:
    """True for valuation rows in the official amount: none of the three blocking flags is set."""
    flags = ["nv_nonfactam", "nv_chain", "nv_attente_dts"]
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(0)) == 0 for f in flags])


def stay_amount(base: Column, weekly: Column) -> Column:
    """Stay amount net of supplements: daily-band plus weekly-band base amounts."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(base, zero) + F.coalesce(weekly, zero)


def from_cents(amount: Column) -> Column:
    """Administrative amounts are stored in cents."""
    return amount * F.lit(0.01)
