"""Column functions and ledger rules with literal expectations (micro-fixtures)."""

from pyspark.sql import functions as F

from votepanel.functions import codes as CD
from votepanel.functions.categories import category_from_list, category_from_name, normalise_bloc, normalise_category
from votepanel.functions.text import canonical_label, name_key, normalise_code, repair_mojibake


def one(spark, col, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_name_key_and_rules(spark):
    names = ["Marine LE PEN", "Benoît Hamon", "Liste Écologistes", "œuvre", "", None]
    assert one(spark, name_key("v"), names) == ["marinelepen", "benoithamon", "listeecologistes", "uvre", "", ""]
    assert one(spark, category_from_name("v"), names) == ["extreme_droite", "gauche_modere", None, None, None, None]
    assert one(spark, category_from_list("v"), ["Liste Écologistes", "Rassemblement National", "x"]) == ["gauche_modere", "extreme_droite", None]


def test_rule_order_first_hit_wins(spark):
    # "lepen" (extreme right) appears before "generation" in the list rules
    assert one(spark, category_from_list("v"), ["generation le pen"]) == ["extreme_droite"]


def test_bloc_normalisers(spark):
    labels = ["Gauche", "droite moderee", "Divers", "EXTREME-DROITE", " gauche_dure ", "doite_dure", "autre", None]
    assert one(spark, normalise_category("v"), labels) == ["gauche_modere", "droite_modere", None, "extreme_droite", "gauche_dure", "droite_dure", None, None]
    assert one(spark, normalise_bloc("v"), labels) == ["gauche_modere", "droite_modere", "centre", "extreme_droite", "gauche_dure", "droite_dure", "centre", "centre"]


def test_codes(spark):
    assert one(spark, normalise_code("v"), [" brand#1 ", "nan", "", "None", "<NA>", None]) == ["BRAND#1", None, None, None, None, None]
    assert one(spark, CD.normalise_insee("v"), ["301", "34301.0", "2A004", "343012", "", None]) == ["00301", "34301", "02004", "34301", None, None]
    df = spark.createDataFrame([("34", "301", "2.0"), ("34", "34301", "12"), ("4", "5", "1")], "d string, t string, s string")
    d, t, s, k = CD.normalise_geo_codes("d", "t", "s")
    assert [tuple(r) for r in df.select(t, s, k).collect()] == [("34301", "0002", "343010002"), ("34301", "0012", "343010012"), ("04005", "0001", "040050001")]


def test_labels_and_mojibake(spark):
    assert one(spark, canonical_label("v"), ["Exprimés", "N° tour"]) == ["exprims", "ntour"]
    assert one(spark, repair_mojibake("v"), ["ExprimÃ©s  \n total", "﻿Nom"]) == ["Exprimés total", "Nom"]


def test_format_delta(spark):
    assert one(spark, CD.format_delta("v"), [1.25, -0.04, -2.35, 12.0, None], "v double") == ["+1.2", "-0.0", "-2.4", "+12.0", "N/A"]


def test_event_key_roundtrip(spark):
    df = spark.createDataFrame([(" Legislatives ", 2024, 2)], "t string, y int, r int")
    k = df.select(CD.event_key("t", "y", "r").alias("k"))
    assert k.first()[0] == "legislatives|2024|2"
    t, y, r = CD.parse_event_key("k")
    assert tuple(k.select(t, y, r).first()) == ("legislatives", 2024, 2)


def test_category_rules_compute_the_key_once(spark):
    """The key is one expression of the plan, not one per rule, and equals the rule written out over odd texts."""
    import unicodedata

    from votepanel.constants import EUROPEAN_LIST_RULES, PRESIDENTIAL_NAME_RULES

    texts = ["", None, " \t ", "LE  PEN", "le\npen", "Benoît HAMON", "Kodak JÁDOT", "İmam Macron", "straße œuvre", "Le Pen, puis génération", "9 MODEM 9", "\U0001f600 pirate", "z" * 5000 + " ÉCOLOG ie"]

    def letters(text):
        low = unicodedata.normalize("NFD", (text or "").lower())
        return "".join(ch for ch in low if "a" <= ch <= "z")

    for column, rules in ((category_from_name("v"), PRESIDENTIAL_NAME_RULES), (category_from_list("v"), EUROPEAN_LIST_RULES)):
        assert one(spark, column, texts) == [next((c for k, c in rules if k in letters(t)), None) for t in texts]
        plan = spark.createDataFrame([(t,) for t in texts], "v string").select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1 and plan.count("lower(") == 1
    assert one(spark, name_key("v"), texts) == [letters(t) for t in texts]
