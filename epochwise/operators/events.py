"""Event JSON in and out, and free-text answers to symptom rows."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from epochwise.functions import text as tx

# Event fields, in order.
EVENT_FIELDS = (
    "ae_id",
    "patient_id",
    "arm_id",
    "epoch",
    "term",
    "soc",
    "ctcae_grade",
    "serious",
    "relatedness",
    "predicted_probability",
    "source",
    "reported_verbatim",
)


def json_items(value: Column) -> Column:
    """Elements of a JSON array as text; null for anything but an array."""
    trimmed = F.trim(value, F.lit(tx.WHITE))
    strict = trimmed.startswith("[") & trimmed.endswith("]") & F.try_parse_json(trimmed).isNotNull()
    return F.when(strict, F.from_json(trimmed, "array<string>"))


def worst_and_serious(value: Column) -> tuple[Column, Column]:
    """Worst grade and any serious flag of a JSON array of events, without exploding it; read as :func:`explode_events` does."""
    fields = StructType([StructField(f, StringType()) for f in ("ctcae_grade", "serious")])
    seen = F.transform(F.filter(json_items(value), lambda x: x.startswith("{")), lambda x: F.from_json(x, fields))
    grade = lambda e: F.coalesce(F.nanvl(e["ctcae_grade"].try_cast("double"), F.lit(None).cast("double")).try_cast("int"), F.lit(1))
    return F.array_max(F.transform(seen, grade)), F.exists(seen, lambda e: F.coalesce(e["serious"].try_cast("boolean"), F.lit(False)))


def explode_events(log: DataFrame, column="adverse_events_json") -> DataFrame:
    """Event rows from a JSON array column.

    Unreadable text, other JSON and elements that are not objects give no rows.
    An unreadable grade is 1, a missing serious flag false, a missing
    probability 0.  All fields come from inside the event.
    """
    item = F.explode(F.filter(json_items(F.col(column)), lambda x: x.startswith("{")))
    fields = StructType([StructField(f, StringType()) for f in EVENT_FIELDS])
    e = log.select(item.alias("item")).select(F.from_json("item", fields).alias("e")).select("e.*")
    return e.select(
        "ae_id",
        "patient_id",
        "arm_id",
        F.col("epoch").try_cast("int").alias("epoch"),
        "term",
        "soc",
        F.coalesce(F.nanvl(F.col("ctcae_grade").try_cast("double"), F.lit(None).cast("double")).try_cast("int"), F.lit(1)).alias("ctcae_grade"),
        F.coalesce(F.col("serious").try_cast("boolean"), F.lit(False)).alias("serious"),
        "relatedness",
        F.coalesce(F.col("predicted_probability").try_cast("double"), F.lit(0.0)).alias("predicted_probability"),
        "source",
        "reported_verbatim",
    )


def collect_events(events: DataFrame, keys: list[str], fields: dict[str, str], grade="grade", term="term", cut: int = 480) -> DataFrame:
    """One JSON array and a short summary per key.

    An epoch holds at most one event per term plus the capped reports, so each
    array is bounded by the term list.
    """
    entry = F.struct(F.col(term).alias("_o"), *[F.col(c).alias(n) for n, c in fields.items()])
    ordered = F.array_sort(F.collect_list(entry))
    spoken = F.array_sort(F.collect_list(F.struct((-F.col(grade)).alias("g"), F.col(term).alias("t"))))
    out = events.groupBy(*keys).agg(ordered.alias("_e"), spoken.alias("_s"))
    plain = F.transform("_e", lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    lines = F.transform("_s", lambda x: F.concat(x["t"], F.lit(" (G"), (-x["g"]).cast("string"), F.lit(")")))
    return out.select(*keys, F.to_json(plain).alias("events_json"), F.substring(F.concat_ws("; ", lines), 1, cut).alias("summary"))


# --------------------------------------------------------------------------
# Free-text answers
# --------------------------------------------------------------------------
# Patterns for fenced blocks and for the usual slips in JSON text.
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
FIRST_OBJECT = r"(?s)(\{.*\})"
FIRST_ARRAY = r"(?s)(\[.*\])"
TRAILING_COMMA = r",\s*([}\]])"
SINGLE_QUOTED_KEY = r"'([^'\\]*)'\s*:"


_LITERALS = StructType([StructField(f"l{i}", StringType()) for i in range(3)])


@F.pandas_udf(_LITERALS)
def literals_to_json(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.DataFrame:
    """JSON text of the first of three candidates that is a Python dict or list literal, under its number; the rest is null."""

    def one(value):
        if value is None:
            return None
        try:
            parsed = ast.literal_eval(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return json.dumps(parsed, default=str) if isinstance(parsed, (dict, list)) else None

    out = {f"l{i}": [None] * len(first) for i in range(3)}
    for at, row in enumerate(zip(first, second, third, strict=True)):
        for i, value in enumerate(row):
            found = one(value)
            if found is not None:
                out[f"l{i}"][at] = found
                break
    return pd.DataFrame(out, dtype=object)


def repair(value: Column) -> Column:
    """Drop trailing commas, double the quotes of keys, lower Python constants."""
    fixed = F.regexp_replace(value, TRAILING_COMMA, "$1")
    fixed = F.regexp_replace(fixed, SINGLE_QUOTED_KEY, '"$1":')
    for word, plain in (("True", "true"), ("False", "false"), ("None", "null")):
        fixed = F.replace(fixed, F.lit(word), F.lit(plain))
    return fixed


# Texts that could be JSON at all; prose is never handed to the parser.
MAYBE_JSON = r"^\s*([\{\[\"]|(-?[0-9][0-9.eE+-]*|true|false|null)\s*$)"


def _readable(value: Column, wanted: Column | None = None) -> Column:
    sensible = value.rlike(MAYBE_JSON) if wanted is None else wanted & value.rlike(MAYBE_JSON)
    return F.when(F.when(sensible, F.try_parse_json(value)).isNotNull(), value)


def read_answers(answers: DataFrame, column="text") -> DataFrame:
    """Add ``payload`` (JSON text), ``repaired`` and ``error`` to each answer.

    The stages are tried in order: whole text, first object, first array; each
    as it is, then repaired, then as a Python literal.  Each step is computed once,
    for the texts that no step before it could read; one Arrow call takes what is left.
    """
    t = F.col(column)
    keep = list(answers.columns)

    def step(df, **made):
        df = _settled(df, keep, [c.alias(n) for n, c in made.items()])
        keep.extend(made)
        return df

    fenced = F.regexp_extract(t, FENCE, 1)
    a = step(answers, _c0=F.trim(F.when(t.rlike(FENCE), fenced).otherwise(t), F.lit(" \n\t\r")))
    a = step(a, _s0=_readable(F.col("_c0")))
    a = step(a, _r0=_readable(repair(F.col("_c0")), F.col("_s0").isNull()))
    unread = F.col("_s0").isNull() & F.col("_r0").isNull()
    a = step(a, _c1=F.when(unread, F.regexp_extract("_c0", FIRST_OBJECT, 1)), _c2=F.when(unread, F.regexp_extract("_c0", FIRST_ARRAY, 1)))
    a = step(a, _s1=_readable(F.col("_c1")), _s2=_readable(F.col("_c2")))
    a = step(a, **{f"_r{i}": _readable(repair(F.col(f"_c{i}")), F.col(f"_s{i}").isNull()) for i in (1, 2)})

    def leftover(i):
        nothing = F.col(f"_s{i}").isNull() & F.col(f"_r{i}").isNull()
        if i == 2:  # what the first object gave comes before the first array
            nothing = nothing & F.col("_s1").isNull() & F.col("_r1").isNull()
        return F.when(nothing & F.col(f"_c{i}").rlike(r"^[\{\[]"), F.col(f"_c{i}"))

    a = a.withColumn("_l", literals_to_json(*[leftover(i) for i in range(3)])).select("*", "_l.*")
    a = a.withColumnsRenamed({f"l{i}": f"_l{i}" for i in range(3)})
    empty = F.coalesce(F.trim(t, F.lit(" \n\t\r")) == "", F.lit(True))
    advice = F.coalesce(tx.gives_advice(t), F.lit(False))
    found = F.coalesce(*[F.col(f"_{k}{i}") for i in range(3) for k in "srl"])
    # the first stage that reads the text decides whether it needed repair
    stage = F.lit(None).cast("string")
    for i in reversed(range(3)):
        for k in "lrs":
            stage = F.when(F.col(f"_{k}{i}").isNotNull(), k).otherwise(stage)
    ok = ~empty & ~advice
    payload = F.when(ok, found)
    kind_ok = payload.rlike(r"^\s*[\{\[]")
    error = (
        F.when(empty, "empty response").when(advice, "safety filter").when(found.isNull(), "unparseable").when(~kind_ok, "unparseable").otherwise("")
    )
    extra = [F.when(error == "", payload).alias("payload"), F.coalesce(ok & (stage.isin("r", "l") | t.rlike(FENCE)) & kind_ok, F.lit(False)).alias("repaired"), error.alias("error")]
    return _settled(a, answers.columns, extra)


def _settled(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """Compute the columns ``made`` once per row.

    A one-element explode keeps later filters above this point; pushed below
    it, they would repeat the parsing expressions many times over.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*made))).alias("_r")).select(*keep, "_r.*")


def _first_text(fields: Column, *names: str) -> Column:
    return F.trim(F.coalesce(*[F.when(F.try_element_at(fields, F.lit(n)) != "", F.try_element_at(fields, F.lit(n))) for n in names], F.lit("")), F.lit(tx.WHITE))


def answer_payloads(answers: DataFrame, column="text") -> DataFrame:
    """Add the symptom array as JSON text (``listing``) and the top-level fields.

    A bare array, a bare symptom object and a single object under ``symptoms``
    are all read as an array.
    """
    a = read_answers(answers, column)
    is_list = F.col("payload").rlike(r"^\s*\[")
    a = a.withColumn("fields", F.when(~is_list, F.from_json("payload", "map<string,string>")))
    has = lambda n: F.coalesce(F.array_contains(F.map_keys("fields"), n), F.lit(False))
    given = F.try_element_at("fields", F.lit("symptoms"))
    wrapped = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    listing = (
        F.when(is_list, F.col("payload"))
        .when(has("symptoms"), F.when(given.rlike(r"^\s*\{"), wrapped(given)).otherwise(given))
        .when(has("term") | has("symptom") | has("name"), wrapped(F.col("payload")))
        .otherwise("[]")
    )
    a = _settled(a, a.columns, [F.when(F.col("error") == "", listing).alias("listing")])
    not_list = (F.col("error") == "") & ~F.coalesce(F.col("listing").rlike(r"^\s*\["), F.lit(False))
    return a.withColumn("error", F.when(not_list, "'symptoms' must be a list").otherwise(F.col("error"))).withColumn(
        "listing", F.when(~not_list, F.col("listing"))
    )


def answer_status(answers: DataFrame, key: str, column="text") -> DataFrame:
    """One row per answer: tolerability, intent, whether repaired, error class."""
    a = answer_payloads(answers, column)

    def enum(name, allowed, default):
        said = tx.normalise_enum(F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(default)), allowed, default)
        return F.when(F.col("error") == "", said).otherwise(default)

    return a.select(
        key,
        enum("overall_tolerability", ("good", "acceptable", "poor"), "acceptable").alias("tolerability"),
        enum("adherence_intent", ("continue", "unsure", "discontinue"), "continue").alias("adherence_intent"),
        "repaired",
        "error",
    )


def symptom_rows(answers: DataFrame, key: str, column="text", limit: int = 5) -> DataFrame:
    """One row per symptom, from the first ``limit`` array elements of an answer.

    Text elements are terms of grade 1, empty ones too; objects may use the alternative field
    names; other elements and objects without a term are skipped.
    """
    a = answer_payloads(answers, column).where("listing is not null")
    items = F.slice(F.try_variant_get(F.try_parse_json("listing"), "$", "array<variant>"), 1, limit)
    rows = a.select(key, F.posexplode(items).alias("i", "x"))
    rows = rows.select(key, "x", (F.col("i") + 1).alias("position"), F.schema_of_variant("x").alias("kind"), F.to_json("x").alias("j"), F.try_variant_get("x", "$", "string").alias("s"))
    is_obj = F.col("kind").startswith("OBJECT")
    rows = rows.withColumn("m", F.when(is_obj, F.from_json("j", "map<string,string>")))
    # a field that is there counts even if null; the JSON type of its value decides how it is read
    field = F.when(F.map_contains_key("m", "ctcae_grade"), "ctcae_grade").otherwise("grade")
    kinds = [F.schema_of_variant(F.try_variant_get("x", f"$.{name}", "variant")) for name in ("ctcae_grade", "grade")]
    rows = rows.select("*", F.when(field == "ctcae_grade", kinds[0]).otherwise(kinds[1]).alias("gk"), F.try_element_at("m", field).alias("g"))
    plain = F.when(F.col("kind") == "STRING", F.trim("s", F.lit(tx.WHITE)))
    term = F.coalesce(plain, F.when(is_obj, _first_text(F.col("m"), "term", "symptom", "name")))
    said = F.coalesce(plain, F.when(is_obj, _first_text(F.col("m"), "verbatim", "quote", "description")))
    return rows.select(
        key,
        "position",
        F.substring(term, 1, 120).alias("term"),
        F.when(is_obj, tx.coerce_grade(F.col("g"), F.col("gk") == "STRING")).otherwise(1).alias("grade"),
        F.substring(said, 1, 400).alias("verbatim"),
        is_obj.alias("_o"),
    ).where("term <> '' OR (NOT _o AND term IS NOT NULL)").drop("_o")
