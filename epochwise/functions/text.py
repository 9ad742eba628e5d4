"""Text columns: templates, estimates, grading and filtering of free answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that make an answer unusable (given advice).
ADVICE_PHRASES = ("you should take", "i recommend", "diagnosis is", "prescribe", "stop taking your")

# Grade words.
GRADE_WORDS = {
    "mild": 1,
    "moderate": 2,
    "severe": 3,
    "life-threatening": 4,
    "life threatening": 4,
    "fatal": 5,
    "death": 5,
}

# Markers of permanent and of transient service errors.
PERMANENT_MARKERS = (
    "validationexception",
    "accessdenied",
    "unauthorized",
    "invalid api key",
    "model not found",
    "does not exist",
    "throttlingexception: model",
)
TRANSIENT_MARKERS = (
    "throttl",
    "too many requests",
    "rate exceeded",
    "timeout",
    "timed out",
    "connection reset",
    "connection aborted",
    "temporarily unavailable",
    "serviceunavailable",
    "service unavailable",
    "internalservererror",
    "internal server error",
    "502",
    "503",
    "504",
    "429",
)

def any_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """True where the lower-cased text holds one of the markers."""
    low = F.lower(text)
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return hit


def gives_advice(text: Column) -> Column:
    return any_marker(text, ADVICE_PHRASES)


def error_class(text: Column, is_network_error: Column | None = None) -> Column:
    """``permanent`` before ``transient``; unknown errors follow the network flag."""
    unknown = F.lit("permanent")
    if is_network_error is not None:
        unknown = F.when(is_network_error, "transient").otherwise("permanent")
    return (
        F.when(any_marker(text, PERMANENT_MARKERS), "permanent")
        .when(any_marker(text, TRANSIENT_MARKERS), "transient")
        .otherwise(unknown)
    )


#: ASCII white space, all of which is trimmed.
WHITE = " \t\r\n\f\v"


def coerce_grade(text: Column, quoted: Column | None = None) -> Column:
    """Grade 1 to 5 from a number, a severity word or the first digit found.

    Where ``quoted`` holds, the value was text in its JSON, so it is not rounded as a number: "10" has the first digit 1.
    """
    t = F.lower(F.trim(text, F.lit(WHITE)))
    number = t.try_cast("double")
    if quoted is not None:
        number = F.when(~F.coalesce(quoted, F.lit(False)), number)
    words = F.create_map(*[F.lit(v) for kv in GRADE_WORDS.items() for v in kv])
    digit = F.regexp_extract(t, "[1-5]", 0)
    return F.coalesce(
        F.when(number.isNotNull() & ~F.isnan(number), F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.rint(number)))).cast("int"),
        F.try_element_at(words, t),
        digit.try_cast("int"),
        F.lit(1),
    )


def normalise_enum(text: Column, allowed: tuple[str, ...], default: str) -> Column:
    t = F.lower(F.trim(text, F.lit(WHITE)))
    return F.when(t.isin(*allowed), t).otherwise(F.lit(default))


def token_estimate(text: Column) -> Column:
    """About four characters to a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def top_entry(m: Column) -> Column:
    """struct(key, value) of the largest map value; the earliest entry wins ties."""
    e = F.map_entries(m)
    ranked = F.transform(
        e, lambda x, i: F.struct(x["value"].alias("value"), (-i).alias("neg"), x["key"].alias("key"))
    )
    best = F.array_max(ranked)
    return F.struct(
        F.coalesce(best["key"], F.lit("none")).alias("key"), F.coalesce(best["value"], F.lit(0.0)).alias("value")
    )


def rule_based_report(probabilities: Column, grade: Column, epoch: Column, threshold: float = 0.15, wording: dict[str, str] | None = None, source: str = "recorded") -> Column:
    """JSON answer put together from recorded term scores and the grade, in the contract of a free-text answer.

    ``wording`` is protocol text: the sentence of a term.  Terms without one are put into a general sentence.
    """
    # Entries from the largest probability down; equal ones keep their map order.
    numbered = F.transform(
        F.map_entries(probabilities),
        lambda x, i: F.struct((-x["value"]).alias("neg"), i.alias("i"), x["key"].alias("term")),
    )
    hits = F.filter(F.array_sort(numbered), lambda x: -x["neg"] >= threshold)
    sentences = F.create_map(*[F.lit(v) for kv in (wording or {}).items() for v in kv])
    symptoms = F.transform(
        F.slice(hits, 1, 3),
        lambda x: F.struct(
            x["term"].alias("term"),
            F.greatest(F.lit(1), F.least(F.lit(5), grade)).alias("ctcae_grade"),
            F.coalesce(
                *([F.try_element_at(sentences, x["term"])] if wording else []),
                F.concat(F.lit("I have some "), F.replace(x["term"], F.lit("_"), F.lit(" ")), F.lit(" since the dose.")),
            ).alias("verbatim"),
        ),
    )
    return F.to_json(
        F.struct(
            symptoms.alias("symptoms"),
            F.when(F.size(symptoms) == 0, "good").when(grade <= 2, "acceptable").otherwise("poor").alias("overall_tolerability"),
            F.when(grade >= 4, "discontinue").when(grade == 3, "unsure").otherwise("continue").alias("adherence_intent"),
            epoch.alias("epoch"),
            F.lit(source).alias("source"),
        )
    )
