"""Tolerant casts for untidy source columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwise.functions.numbers import finite
from epochwise.functions.text import WHITE

# Texts that count as true.
TRUE_WORDS = ("1", "true", "yes", "y", "t")

# Neutral defaults for cohort measures that are missing or unreadable.
COHORT_DEFAULTS = {
    "age": 55.0,
    "weight_kg": 75.0,
    "height_cm": 170.0,
    "bmi": 26.0,
    "baseline_sbp": 130.0,
    "baseline_dbp": 80.0,
    "baseline_hr": 72.0,
    "egfr": 90.0,
    "alt_u_l": 25.0,
    "ast_u_l": 24.0,
    "creatinine_mg_dl": 0.9,
    "alcohol_units_week": 0.0,
}


def to_double(value: Column, default: float = 0.0) -> Column:
    """Number read from any column; null, NaN and unreadable text give the default."""
    return F.coalesce(finite(value.cast("string").try_cast("double")), F.lit(float(default)))


def to_bool(value: Column) -> Column:
    """Boolean read from text, number or boolean; everything unknown is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"), F.lit(WHITE))).isin(*TRUE_WORDS), F.lit(False))


def to_text(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def to_list(value: Column) -> Column:
    """Array of strings from a JSON array, a JSON string, or comma-separated text."""
    text = F.trim(value, F.lit(WHITE))
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p, F.lit(WHITE))), lambda p: p != "")
    quoted = F.when(text.rlike('^"[^"]*"$'), F.array(F.get_json_object(text, "$")))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        F.coalesce(F.from_json(text, "array<string>"), quoted, pieces)
    )


def age_band(age: Column) -> Column:
    return F.when(age < 40, "18-39").when(age < 60, "40-59").otherwise("60+")


# Exposure multiplier by CYP2D6 metaboliser class.
CYP2D6_MULTIPLIER = {"PM": 1.35, "IM": 1.175, "NM": 1.0, "UM": 0.825}


def exposure_multiplier(metaboliser: Column) -> Column:
    pairs = [F.lit(v) for kv in CYP2D6_MULTIPLIER.items() for v in kv]
    return F.element_at(F.create_map(*pairs), metaboliser)


def flag(value: Column) -> Column:
    """0/1 double of a boolean; null counts as 0."""
    return F.when(value, 1.0).otherwise(0.0)


def yes_no(value: Column) -> Column:
    return F.when(value, "Y").otherwise("N")


def subject_code(study: str, subject: Column) -> Column:
    return F.concat_ws("-", F.lit(study), subject.cast("string"))


def arm_code(arm: Column) -> Column:
    return F.substring(F.upper(arm), 1, 8)
