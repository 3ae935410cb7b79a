"""Fixed vocabulary of the voting panel.

The values under "fixed values" are part of the data contract (model output order, party-name rules,
label synonyms). They must stay exactly as written for results to agree with the original pipeline.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# The 7 political categories, in model-output order.
CATEGORIES: tuple[str, ...] = (
    "centre",
    "gauche_modere",
    "droite_modere",
    "gauche_dure",
    "droite_dure",
    "extreme_gauche",
    "extreme_droite",
)

# Display order of the categories (left to right), then the non-candidate rows.
DISPLAY_ORDER: tuple[str, ...] = (
    "extreme_gauche",
    "gauche_dure",
    "gauche_modere",
    "centre",
    "droite_modere",
    "droite_dure",
    "extreme_droite",
)
EXTRA_ROWS: tuple[str, ...] = ("blancs", "nuls", "abstention")

# Presidential candidate surname key -> category (first substring hit wins, in this order).
PRESIDENTIAL_NAME_RULES: tuple[tuple[str, str], ...] = (
    ("arthaud", "extreme_gauche"),
    ("poutou", "extreme_gauche"),
    ("melenchon", "gauche_dure"),
    ("roussel", "gauche_dure"),
    ("hidalgo", "gauche_modere"),
    ("jadot", "gauche_modere"),
    ("hamon", "gauche_modere"),
    ("macron", "centre"),
    ("lassalle", "centre"),
    ("cheminade", "centre"),
    ("pecresse", "droite_modere"),
    ("fillon", "droite_modere"),
    ("dupontaignan", "droite_dure"),
    ("asselineau", "droite_dure"),
    ("lepen", "extreme_droite"),
    ("zemmour", "extreme_droite"),
)

# European list-name keyword -> category (first substring hit wins, in this order).
EUROPEAN_LIST_RULES: tuple[tuple[str, str], ...] = (
    ("rassemblementnational", "extreme_droite"),
    ("lepen", "extreme_droite"),
    ("republiqueenmarche", "centre"),
    ("renaissance", "centre"),
    ("modem", "centre"),
    ("franceinsoumise", "gauche_dure"),
    ("lutteouvriere", "extreme_gauche"),
    ("revolutionnairecommunistes", "extreme_gauche"),
    ("communiste", "gauche_dure"),
    ("deboutlafrance", "droite_dure"),
    ("dupontaignan", "droite_dure"),
    ("frexit", "droite_dure"),
    ("patriotes", "droite_dure"),
    ("uniondeladroite", "droite_modere"),
    ("droiteetducentre", "droite_modere"),
    ("printempseuropeen", "gauche_modere"),
    ("generation", "gauche_modere"),
    ("animaliste", "gauche_modere"),
    ("ecolog", "gauche_modere"),
    ("federaliste", "centre"),
    ("pirate", "centre"),
    ("citoyenseuropeens", "centre"),
    ("leseuropeens", "centre"),
    ("lesoubliesdeleurope", "centre"),
    ("initiativecitoyenne", "centre"),
    ("esperanto", "centre"),
    ("europeauservicedespeuples", "droite_dure"),
    ("franceroyale", "extreme_droite"),
    ("pourleuropedesgens", "gauche_dure"),
    ("allonsenfants", "droite_modere"),
    ("alliancejaune", "centre"),
    ("giletsjaunes", "centre"),
)

# Bloc label synonyms of the strict normaliser (unknown -> null).
CATEGORY_SYNONYMS_STRICT: dict[str, str | None] = {
    "doite_dure": "droite_dure",
    "droite_moderee": "droite_modere",
    "gauche_moderee": "gauche_modere",
    "extreme_gauche": "extreme_gauche",
    "extreme_droite": "extreme_droite",
    "divers": None,
    "gauche": "gauche_modere",
    "droite": "droite_modere",
}

# Bloc label synonyms of the lenient normaliser (unknown -> centre).
CATEGORY_SYNONYMS_LENIENT: dict[str, str] = {
    "droite_moderee": "droite_modere",
    "gauche_moderee": "gauche_modere",
    "doite_dure": "droite_dure",
    "gauche": "gauche_modere",
    "droite": "droite_modere",
    "divers": "centre",
    "divers_droite": "droite_modere",
    "divers_gauche": "gauche_modere",
    "divers_centre": "centre",
    "extreme_gauche": "extreme_gauche",
    "extreme_droite": "extreme_droite",
}

# Textual nulls in code columns (after trim + upper).
TEXTUAL_NULLS: tuple[str, ...] = ("NAN", "NONE", "", "<NA>")
# ---------------------------------------------------------------------------------------------

# Column vocabulary of the long table and the panel.
INDEX_COLS: tuple[str, ...] = (
    "commune_code",
    "code_bv",
    "election_type",
    "election_year",
    "round",
    "date_scrutin",
)
EVENT_COLS: tuple[str, ...] = ("election_type", "election_year", "round")
LONG_MEASURES: tuple[str, ...] = ("inscrits", "votants", "abstentions", "blancs", "nuls", "exprimes", "voix")

# Panel feature families: (prefix, source column of the event-category table).
PANEL_FEATURES: tuple[tuple[str, str], ...] = (
    ("target_share_", "share"),
    ("prev_share_any_lag1_", "share_lag_any"),
    ("prev_share_type_lag1_", "share_lag_same_type"),
    ("prev_dev_to_national_any_lag1_", "dev_to_nat_lag_any"),
    ("prev_dev_to_national_type_lag1_", "dev_to_nat_lag_same_type"),
    ("swing_any_", "swing_any"),
)

TARGET_COLS: tuple[str, ...] = tuple(f"target_share_{c}" for c in CATEGORIES)
