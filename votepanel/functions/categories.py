"""Political-category column functions: label normalising and name/keyword fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from votepanel.constants import (
    CATEGORIES,
    CATEGORY_SYNONYMS_LENIENT,
    CATEGORY_SYNONYMS_STRICT,
    EUROPEAN_LIST_RULES,
    PRESIDENTIAL_NAME_RULES,
)
from votepanel.functions.text import _col, name_key, once, strip_ws


def _q(v: str | None) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"


def _map_literal(pairs) -> Column:
    """SQL map literal built in one expression (one gateway call instead of one per entry)."""
    return F.expr("map(" + ", ".join(f"{_q(k)}, {_q(v)}" for k, v in pairs) + ")")


def _label_key(c: Column | str) -> Column:
    low = F.lower(strip_ws(_col(c).cast("string")))
    return F.translate(low, " -", "__")


def _apply_synonyms(key: Column, synonyms: dict) -> Column:
    m = _map_literal(synonyms.items())
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(key)


def _is_category(c: Column) -> Column:
    return F.array_contains(F.expr("array(" + ", ".join(_q(x) for x in CATEGORIES) + ")"), c)


def normalise_category(c: Column | str) -> Column:
    """Strict bloc normaliser: known synonym or category, else null (``divers`` and unknown -> null)."""
    mapped = _apply_synonyms(_label_key(c), CATEGORY_SYNONYMS_STRICT)
    return F.when(_is_category(mapped), mapped).otherwise(F.lit(None).cast("string"))


def normalise_bloc(c: Column | str) -> Column:
    """Lenient bloc normaliser: null and unknown labels fall to ``centre``."""
    mapped = _apply_synonyms(_label_key(c), CATEGORY_SYNONYMS_LENIENT)
    return F.when(_col(c).isNotNull() & F.coalesce(_is_category(mapped), F.lit(False)), mapped).otherwise(F.lit("centre"))


def _first_contains(key: Column, rules) -> Column:
    """Category of the first rule whose needle occurs in ``key`` (rule order is significant); the key is computed once, and the
    rules after a hit are not tried."""

    def first_hit(k: Column) -> Column:
        return reduce(lambda cases, rule: cases.when(F.contains(k, F.lit(rule[0])), F.lit(rule[1])), rules, F.when(k == "", F.lit(None).cast("string")))

    return once(key, first_hit)


def category_from_name(c: Column | str) -> Column:
    """Presidential candidate name -> category by ordered surname rules (first hit wins)."""
    return _first_contains(name_key(c), PRESIDENTIAL_NAME_RULES)


def category_from_list(c: Column | str) -> Column:
    """European list name -> category by ordered keyword rules (first hit wins)."""
    return _first_contains(name_key(c), EUROPEAN_LIST_RULES)


def category_index(c: Column | str) -> Column:
    """0-based position in the model-output order (tie-break key); null for unknown labels."""
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), _col(c)).cast("int") - 1


def categories_array() -> Column:
    return F.array(*[F.lit(x) for x in CATEGORIES])
