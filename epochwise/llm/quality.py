"""Quality rules with thresholds from the corpus itself.

Each document gets a few whole-number measures.  Their distribution per language and source is kept in a mergeable
quantile sketch: counters over log-linear cells (a value keeps its leading CELL_BITS bits, so a cell is at most 1/128 of
its value wide).  Sketches merge by adding counters, in any order and with the same result, so partial sums run before the
shuffle, a source with a third of all rows sends a few hundred counters per task, and the sketches of small groups merge
into the one of their language, or of the corpus.  Fences are read off the sketches and joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.llm.base import arrow_schema, query, table
from epochwise.operators.joins import hot_split_join
from epochwise.operators.ranks import SMALL_SIDE_ROWS
from epochwise.session import cut_lineage

#: Fixed rules: least words; per cent of words in repeated windows; words of a window; symbols.
LEAST_WORDS, MOST_REPEATED, WINDOW, SYMBOLS = 10, 20, 5, "#*$%&|<>"
#: Leading bits that a counter's cell keeps.
CELL_BITS = 8
#: Documents that a group's own sketch needs; smaller groups use the merged sketch of the language, then of the corpus.
LEAST_ROWS = 200
#: A fence lies REACH times the distance from the median to the quartile beyond the median; quartiles hold though a tenth is junk.
TAIL_PERCENT, REACH = 25, 4
#: measure: (numerator, denominator, least distance of a fence from the median, fences) in thousandths.
MEASURES = {
    "word_length": ("word_chars", "n_words", 1500, "both"),
    "symbol_share": ("n_symbols", "n_words", 150, "upper"),
    "line_copies": ("n_dup_lines", "n_lines", 400, "upper"),
    "repeat_share": ("n_repeat_words", "n_words", 200, "upper"),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_FEATURES = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more."""
    runs = len(words) - window + 1
    if runs < 2:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    bits = max(1, (len(number) - 1).bit_length())
    if bits * window < 63:  # word numbers side by side
        run = code[:runs].copy()
        for k in range(1, window):
            run = run << bits | code[k : k + runs]
    else:  # numbers of ever longer runs
        run = code[:runs]
        for k in range(1, window):
            run = np.unique(run * len(number) + code[k : k + runs], return_inverse=True)[1]
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    again = np.zeros(runs, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """(words, their code points, symbols, repeated lines, words in repeated runs, lines with a word); null is empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes: ASCII white space only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row of counts per input row."""
    schema = arrow_schema(_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                counts = np.array([measures(t) for t in part.column(3).to_pylist()], np.int64).reshape(-1, len(_COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(counts[:, k]) for k in range(len(_COUNTS)))], schema=schema)

    kinds = (id_col, "long", "doc_id"), (lang_col, "string", "lang"), (source_col, "string", "source"), (text_col, "string", "text")
    return docs.select(*(F.col(c).cast(t).alias(n) for c, t, n in kinds)).mapInArrow(run, _FEATURES)


def cell(value: str) -> str:
    """SQL for the lower end of a value's cell; the value itself below 2 ** CELL_BITS."""
    shift = f"greatest(0, length(bin({value})) - {CELL_BITS})"
    return f"(({value} >> {shift}) << {shift})"


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, cell, n): counters of each measure of the rows that the fixed rules keep."""
    pairs = [F.struct(F.lit(m).alias("measure"), F.expr(f"1000L * {num} DIV greatest({den}, 1L)").alias("v")) for m, (num, den, *_) in MEASURES.items()]
    long = rows.where("NOT base_failed").select(*by, F.explode(F.array(*pairs)).alias("m")).select(*by, "m.measure", "m.v")
    return long.groupBy(*by, "measure", F.expr(cell("v")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merged(counters: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: the sums of their parts' counters."""
    return counters.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))


def fences(counters: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, low_<measure>, high_<measure>): fences of each group's sketch.

    The quantile at p per cent is the cell of the value with rank ceil(p * rows / 100); windows run over one group's cells.
    """
    key = W.partitionBy(*by, "measure")
    to = F.sum("n").over(key.orderBy("cell"))
    ranked = counters.withColumn("to", to).withColumn("rows", F.sum("n").over(key))
    at = {p: F.min(F.when(F.col("to") * 100 >= F.col("rows") * p, F.col("cell"))).alias(f"q{p}") for p in (TAIL_PERCENT, 50, 100 - TAIL_PERCENT)}
    q = ranked.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), *at.values())
    q = q.select(
        *by,
        "measure",
        "rows",
        F.expr(f"q50 - greatest({REACH} * (q50 - q{TAIL_PERCENT}), {_DISTANCE})").alias("low"),
        F.expr(f"q50 + greatest({REACH} * (q{100 - TAIL_PERCENT} - q50), {_DISTANCE})").alias("high"),
    )
    cols = [F.max("rows").alias("rows")]
    for m, (*_, sides) in MEASURES.items():
        if sides == "both":
            cols.append(F.max(F.when(F.col("measure") == m, F.col("low"))).alias(f"low_{m}"))
        cols.append(F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"high_{m}"))
    return q.groupBy(*by).agg(*cols)


_DISTANCE = "CASE measure " + " ".join(f"WHEN '{m}' THEN {d}" for m, (_, _, d, _) in MEASURES.items()) + " END"
_GROUP = ["group", "lang_key"]


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(group, rows, fences): every group's own fences, or those of the merged sketch if it has too few rows."""
    own = cut_lineage(sketches(rows, _GROUP))
    limits = [c for c in fences(own, _GROUP).columns if c not in (*_GROUP, "rows")]
    whole = fences(merged(own, []), [])
    lang = fences(merged(own, ["lang_key"]), ["lang_key"])
    # the corpus' fences are one row of a few numbers; a language without enough rows takes them
    row = whole.select(*limits).first()
    every = F.struct(*(F.lit(row[c]).cast("long").alias(c) for c in limits))
    up = lang.select("lang_key", F.when(F.col("rows") >= least_rows, F.struct(*limits)).otherwise(every).alias("up"))
    each = fences(own, _GROUP).join(up, "lang_key")
    chosen = F.when(F.col("rows") >= least_rows, F.struct(*limits)).otherwise(F.col("up")).alias("f")
    return each.select("group", "rows", chosen).select("group", F.col("rows").alias("group_rows"), "f.*")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """(doc_id, counts, base_failed, fences, kept), a row per input row, repeated rows included.

    Null texts are empty and fail.  A null language or source is a group of its own, apart from the text "null".  Values on
    a fence are kept.  Fences come from the rows that the fixed rules keep.
    """
    key = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    failed = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    rows = features(docs, id_col, text_col, lang_col, source_col).select(
        "doc_id", key.alias("group"), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}).alias("lang_key"), *_COUNTS, failed.alias("base_failed")
    )
    rows = cut_lineage(rows)
    limits = cut_lineage(thresholds(rows, least_rows))
    if limits.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS:
        joined = rows.join(F.broadcast(limits), "group", "left")
    else:  # more groups than a broadcast should hold; the hottest keys apart
        joined = hot_split_join(rows, limits, "group")
    inside = F.lit(True)
    for m, (num, den, _, sides) in MEASURES.items():
        v = F.expr(f"1000L * {num} DIV greatest({den}, 1L)")
        inside = inside & (v <= F.col(f"high_{m}"))
        if sides == "both":
            inside = inside & (v >= F.col(f"low_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("group", "lang_key")


def _oracle() -> str:
    """The query in DuckDB: windows by unnesting, sketches as grouped cells."""
    space = "[\\x20\\x09-\\x0D]"
    pairs = " UNION ALL ".join(f"SELECT grp, lk, '{m}' AS measure, 1000 * {num} // greatest({den}, 1) AS v FROM f WHERE NOT base_failed" for m, (num, den, *_) in MEASURES.items())

    def level(name: str, by: str) -> str:
        return f"""
{name}_q AS (SELECT {by}, measure, max(rows) AS rows, min(CASE WHEN upto * 100 >= rows * {TAIL_PERCENT} THEN cell END) AS q1,
             min(CASE WHEN upto * 100 >= rows * 50 THEN cell END) AS q2, min(CASE WHEN upto * 100 >= rows * {100 - TAIL_PERCENT} THEN cell END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by}, measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}, measure) AS rows
            FROM (SELECT {by}, measure, cell, count(*) AS n FROM c GROUP BY ALL)) GROUP BY ALL),
{name} AS (SELECT {by}, measure, rows, q2 - greatest({REACH} * (q2 - q1), {_DISTANCE}) AS low, q2 + greatest({REACH} * (q3 - q2), {_DISTANCE}) AS high FROM {name}_q)"""

    tests = " AND ".join(
        f"1000 * {num} // greatest({den}, 1) <= max(high) FILTER (measure = '{m}')"
        + (f" AND 1000 * {num} // greatest({den}, 1) >= max(low) FILTER (measure = '{m}')" if sides == "both" else "")
        for m, (num, den, _, sides) in MEASURES.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {{'lang': lang, 'source': source}}::VARCHAR AS grp, coalesce('x' || lang, 'null') AS lk,
                  regexp_extract_all(coalesce(text, ''), '{space.replace("[", "[^", 1)}+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
h AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT r, i, unnest(range(0, {WINDOW})) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_replace(line, '{space}', '', 'g') <> '' GROUP BY r),
f0 AS (SELECT d.r, doc_id, grp, lk, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
              length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
              coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
       FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f0),
c AS (SELECT grp, lk, 1 AS one, measure, (v >> s) << s AS cell FROM (SELECT *, greatest(0, length(bin(v)) - {CELL_BITS}) AS s FROM ({pairs}))),
{level("own", "grp, lk")}, {level("tongue", "lk")}, {level("whole", "one")},
b AS (SELECT own.grp, measure, CASE WHEN own.rows >= {LEAST_ROWS} THEN own.low WHEN tongue.rows >= {LEAST_ROWS} THEN tongue.low ELSE whole.low END AS low,
             CASE WHEN own.rows >= {LEAST_ROWS} THEN own.high WHEN tongue.rows >= {LEAST_ROWS} THEN tongue.high ELSE whole.high END AS high
      FROM own JOIN tongue USING (lk, measure) JOIN whole USING (measure))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({tests}, false) AS kept
FROM f LEFT JOIN b USING (grp)
GROUP BY r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed
"""


@query("op12_quality", _oracle())
def op12_quality(spark, sf_dir):
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
