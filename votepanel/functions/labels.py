"""Header labels of raw result files -> one vocabulary, as ordered rules over schema metadata.

A rule is a pattern for the whole folded label (lower case, without accents and degree signs, blanks squeezed; letters that a
wrong decoding lost are optional), the name it gives, and what happens to the first number of the label: ``keep`` appends it, ``first``
appends it or 1, ``drop`` leaves it out. The first rule that matches decides; a label without a rule keeps its own name.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votepanel.functions.text import MOJIBAKE_PAIRS, repair_mojibake, strip_accents

# The names of the vocabulary; patterns are ours.
RULES: tuple[tuple[str, str, str], ...] = (
    # rates
    (r"% abstentions", "% Abs/Ins", "drop"),
    (r"% blancs/inscrits", "% Blancs/Ins", "drop"),
    (r"% blancs/votants", "% Blancs/Vot", "drop"),
    (r"% exprime?s/inscrits", "% Exp/Ins", "drop"),
    (r"% exprime?s/votants", "% Exp/Vot", "drop"),
    (r"% nuls/inscrits", "% Nuls/Ins", "drop"),
    (r"% nuls/votants", "% Nuls/Vot", "drop"),
    (r"% vot/ins", "% Votants", "drop"),
    (r".*voix/exp.*", "% Voix/Exp", "keep"),
    (r".*voix/ins.*", "% Voix/Ins", "keep"),
    # places and rounds
    (r"no? tour", "N° tour", "drop"),
    (r"bv|numero bureau de vote|no? ?de bureau de vote|code (du )?b\.?vote|code bv", "Numéro bureau de vote", "drop"),
    (r"code commune", "Code de la commune", "drop"),
    (r"libelle? (de la )?commune", "Libellé de la commune", "drop"),
    (r"code (du )?de?partement", "Code du département", "drop"),
    (r"libelle? (du )?de?partement", "Libellé du département", "drop"),
    (r"libelle? de la circonscription", "Libellé de la circonscription", "drop"),
    # totals
    (r"exprime?s([. ]+\d+)?", "Exprimés", "drop"),
    (r"votants.*\d.*", "Votants", "drop"),
    (r"nombre de voix.*|voix[. ]\d+", "Voix", "keep"),
    # lists and panels
    (r"n ?liste", "N°Liste", "drop"),
    (r"n\.pan.*|(numero )?(n ?)?panneau[. ]?\d*|n de de?po?t (du candidat|de la liste).*", "N°Panneau", "keep"),
    (r"binome", "Binôme", "drop"),
    (r"libelle? abre?ge? .*liste.*|libelle? .*liste.* abre?ge?.*", "Libellé Abrégé Liste", "first"),
    (r"libelle? etendu .*liste.*|libelle? de liste.*|liste.*", "Libellé Etendu Liste", "first"),
    # parties
    (r"code nuance.*\d.*", "Code Nuance", "keep"),
    (r"code nuance.*(candidat|liste).*", "Code Nuance", "drop"),
    (r"nuance (liste|candidat).*", "Nuance", "keep"),
    # people
    (r"nom (du )?candidat.*\d.*|nom te?te de liste \d+", "Nom", "keep"),
    (r"nom te?te de liste", "Nom Tête de Liste", "drop"),
    (r"nom du candidat.* te?te de liste.*", "Nom du candidat tête de liste", "drop"),
    (r"nom (du )?candidat.*", "Nom du candidat", "drop"),
    (r"nom.*\d.*", "Nom", "keep"),
    (r"prenom|prnom du candidat tte de liste", "Prénom", "first"),
    (r"pre?nom (du )?candidat.*\d.*", "Prénom", "keep"),
    (r"pre?nom (du )?candidat.* tete de liste.*", "Prénom du candidat tête de liste", "drop"),
    (r"pre?nom (du )?candidat.*", "Prénom du candidat", "drop"),
    (r"pre?nom.*\d.*", "Prénom", "keep"),
    (r"sexe( candidat)?", "Sexe", "first"),
    (r"sexe.*\d.*", "Sexe", "keep"),
)


def folded(label: Column) -> Column:
    plain = F.regexp_replace(repair_mojibake(label), "Â?[°º]", "")
    return F.regexp_replace(F.lower(strip_accents(plain)), r"\s*/\s*", "/")


def harmonised(label: Column) -> Column:
    """The name of the vocabulary for a raw label (null stays null)."""
    key = folded(label)
    number = F.regexp_extract(key, r"(\d+)", 1)
    out = None
    for pattern, name, policy in RULES:
        numbered = F.when(number != "", F.concat(F.lit(name + " "), number)).otherwise(F.lit(f"{name} 1" if policy == "first" else name))
        value = F.lit(name) if policy == "drop" else numbered
        hit = key.rlike(f"^(?:{pattern})$")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(label)


def harmonise_label(label: str) -> str:
    """The same rules for one header on the driver."""
    text = label.replace("﻿", "")
    for bad, good in MOJIBAKE_PAIRS:
        text = text.replace(bad, good)
    text = re.sub("Â?[°º]", "", re.sub(r"\s+", " ", text).strip())
    key = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn").lower()
    key = re.sub(r"\s*/\s*", "/", key)
    number = re.search(r"\d+", key)
    for pattern, name, policy in RULES:
        if re.fullmatch(pattern, key):
            if policy == "drop" or (policy == "keep" and not number):
                return name
            return f"{name} {number[0] if number else 1}"
    return label


def harmonise_labels(schema: DataFrame, *, file: str = "file", label: str = "label", position: str = "position") -> DataFrame:
    """Schema rows (file, label, position) with their ``harmonised`` name and what becomes of columns of one file that meet under a name:
    ``take`` 1 is the column that keeps it, later ones (by position) fill its nulls, and ``n_same`` says how many meet."""
    same = Window.partitionBy(file, "harmonised")
    out = schema.withColumn("harmonised", harmonised(F.col(label)))
    return out.withColumns({"take": F.row_number().over(same.orderBy(position, label)), "n_same": F.count(F.lit(1)).over(same)})


def harmonise_columns(df: DataFrame) -> DataFrame:
    """A frame under the vocabulary: columns that meet under a name become one, the first non-null from left to right."""
    from votepanel.sources.delimited import dedupe_columns

    return dedupe_columns(df, {c: harmonise_label(c) for c in df.columns})
