"""Personal data by fixed forms and by bootstrapped contexts; DataFrame expressions only.

Spans of the four fixed forms are the seeds.  The words around a seed (the one before it, the two before it, the one before
and the one after it) are lexical patterns of its kind.  What no fixed form covers is open to a kind if it has that kind's
loose class of shapes.  Pattern-instance edges are scored in rounds: a pattern is worth the mean score of its distinct
instances of the class, an instance the noisy-or of its trusted patterns.  Instances that trusted patterns reach are added as
further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.base import query, table
from epochwise.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Fixed forms.  Look-behinds start a search at the head of a run only, and possessive loops never back up: both give the
# matches of the plain patterns, in linear time and without deep recursion.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text must hold to have a match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens with a digit, an at sign or a bracketed one, 6 characters at least; runs of numbers with spaces between them.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{6})[^\x20\x09-\x0D]*?(?:[0-9@]|[(\[{]at[)\]}])[^\x20\x09-\x0D]*+"
RUN = r"(?<![^\x20\x09-\x0D])(?=[0-9().-]*+\x20)[(]?[0-9]++(?:[().-]{0,2}+\x20?[(]?[0-9]++)++(?=[.,;:!?)]*+(?:[\x20\x09-\x0D]|$))"
#: Classes of shapes, wider than the fixed forms, among which the patterns of a kind are measured; marks may follow.
LOOSE = {
    "email": r"^[^@]+@[^@]+$|^.+[(\[{]at[)\]}].+$",
    "ip": r"^[0-9]+(?:[.:][0-9]+){2,}[.,;:!?)]*$",
    "card": r"^[0-9](?:[ .-]?[0-9]){9,21}[.,;:!?)]*$",
    "phone": r"^[(]?[0-9](?:[ ().-]{0,3}[0-9]){5,14}[.,;:!?)]*$",
}
MARK = "\x01"
#: A pattern is trusted with so many distinct instances and such a mean score; an instance is added from this score on.
MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE = 5, 0.9, 0.9
ROUNDS = 3
#: Characters before a span in which its left word is looked for.
REACH = 64


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, text), code points, of the leftmost non-overlapping matches."""
    pieces = F.when(guard, F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)).otherwise(F.array(F.lit("")))
    # The running length of the pieces gives the starts; matches are the odd pieces.
    empty = F.expr("cast(array() AS array<struct<start: long, end: long, text: string>>)")
    state = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(False).alias("odd"), empty.alias("out"))

    def step(acc, piece):
        end = acc["pos"] + F.char_length(piece).cast("long")
        one = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), piece.alias("text")))
        return F.struct(end.alias("pos"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, state, step, lambda acc: acc["out"])


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= F.lit("255"))))
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(9, 15)
    if kind == "card":
        digits = F.regexp_replace(text, "[ -]", "")
        n = F.length(digits)

        def add(total, i):
            d = F.substring(digits, i, F.lit(1)).cast("int")
            return total + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return n.between(12, 19) & (F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)).otherwise(1) % 10 == 0)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, no, end, kind, text) of the fixed forms, by start and kind; null is empty."""
    clean = F.translate(F.coalesce(text, F.lit("")), MARK, "\x02")
    parts = []
    for no, kind in enumerate(KINDS):
        need = NEEDS[kind]
        guard = F.contains(clean, F.lit(need)) if need else clean.rlike("[0-9]{2}|[0-9][ -][0-9]")
        parts.append(_of_kind(no, kind, _found(clean, FORMS[kind], guard)))
    return F.array_sort(F.concat(*parts))


def _of_kind(no: int, kind: str, hits: Column) -> Column:
    valid = F.filter(hits, lambda x: _valid(kind, x["text"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text")))


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """Patterns of a place: the lower-case word before it, the two before it, the one before and the one after it; read over
    REACH characters to either side.  None without a word before it."""
    plain = lambda x: F.lower(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " "))
    at = F.greatest(start - REACH, F.lit(0))
    before = F.trim(plain(F.substring(text, (at + 1).cast("int"), (start - at).cast("int"))))
    one, two = F.substring_index(before, " ", -1), F.substring_index(before, " ", -2)
    after = F.substring_index(F.ltrim(plain(F.substring(text, (end + 1).cast("int"), F.lit(REACH)))), " ", 1)
    ways = F.array(F.concat(one, F.lit(" _")), F.when(two != one, F.concat(two, F.lit(" _"))), F.when(after != "", F.concat(one, F.lit(" _ "), after)))
    return F.when(one == "", F.expr("cast(array() AS array<string>)")).otherwise(F.array_compact(ways))


def _classes(text: Column) -> Column:
    """Kinds whose loose class a text is in."""
    return F.array_compact(F.array(*[F.when(text.rlike(LOOSE[k]), F.lit(k)) for k in KINDS]))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def spotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(row, doc_id, base, tokens): seeds and uncovered tokens of each row, with their contexts; on demand a digest of the text."""
    own = [_digest(F.col(text_col)).alias("digest")] if digests else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    own = ["digest"] if digests else []
    clean = F.translate(F.coalesce("text", F.lit("")), MARK, "\x02")
    with_base = rows.select("doc_id", *own, clean.alias("clean"), base_spans(F.col("text")).alias("base"))
    every = F.concat(_found(F.col("clean"), TOKEN, F.col("clean").rlike(r"[0-9@]|[(\[{]at[)\]}]")), _found(F.col("clean"), RUN, F.col("clean").rlike("[0-9][().-]*[ ][(]?[0-9]")))
    both = with_base.select("*", F.transform(every, lambda x: F.struct(x["start"], x["end"], F.lower(x["text"]).alias("text"), _classes(F.lower(x["text"])).alias("kinds"))).alias("every"))
    open_ = F.filter("every", lambda x: (F.size(x["kinds"]) > 0) & ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    ways = lambda x: _contexts(F.col("clean"), x["start"], x["end"]).alias("ways")
    tokens = F.transform(open_, lambda x: F.struct(x["start"], x["end"], x["text"], x["kinds"], ways(x)))
    seeds = F.transform("base", lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"], F.lower(x["text"]).alias("text"), ways(x)))
    return both.select(F.monotonically_increasing_id().alias("row"), "doc_id", *own, seeds.alias("base"), tokens.alias("tokens"))


def bootstrap(found: DataFrame) -> DataFrame:
    """(instance, pattern, kind): trusted ways to further instances, from the seeds and tokens of all rows."""
    spread = lambda name, kinds: found.select(F.explode(name).alias("s")).select(F.col("s.text").alias("instance"), F.explode(kinds).alias("kind"), F.col("s.ways").alias("ways"))
    places = spread("base", F.array("s.kind")).withColumn("seed", F.lit(True)).unionByName(spread("tokens", F.col("s.kinds")).withColumn("seed", F.lit(False)))
    # a pattern without a seed among its instances can only be reached by instances, so the whole graph is kept
    edges = cut_lineage(places.select("instance", "kind", "seed", F.explode("ways").alias("pattern")).groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")))
    base = edges.where("seed").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    score = base
    width = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT)
    wide = cut_lineage(edges.join(width, ["pattern", "kind"]))
    trusted = None
    for k in range(ROUNDS):
        held = wide.join(score, ["instance", "kind"]).groupBy("pattern", "kind", "n").agg(F.sum("score").alias("total"))
        trusted = held.where(F.col("total") / F.col("n") >= MIN_PATTERN).select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("worth"))
        reached = wide.where("NOT seed").join(trusted, ["pattern", "kind"])
        worth = reached.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("worth"))))).alias("score"))
        if k < ROUNDS - 1:
            score = cut_lineage(base.unionByName(worth).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    best = worth.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")).where(F.col("score") >= MIN_INSTANCE)
    return reached.select("instance", "pattern", "kind").join(best.select("instance", "kind"), ["instance", "kind"]).distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, base, spans): a row per input row; arrays of (start, no, end, kind) by start and kind.

    Null and empty texts have no spans.  Repeated rows and null ids keep their rows.  ``spans`` holds ``base`` and what
    the trusted patterns add.  With ``digests`` a column names the text that a row's positions belong to.
    """
    found = cut_lineage(spotted(docs, id_col, text_col, digests))
    ways = bootstrap(found)
    tokens = found.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", F.col("t.text").alias("instance"), F.explode("t.ways").alias("pattern"))
    number = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)]), F.col("kind"))
    extra = tokens.join(ways, ["instance", "pattern"]).groupBy(F.col("row").alias("at")).agg(F.collect_set(F.struct("start", number.alias("no"), "end", "kind")).alias("extra"))
    base = F.transform("base", lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"]))
    none = F.expr("cast(array() AS array<struct<start: long, no: int, end: long, kind: string>>)")
    own = ["digest"] if digests else []
    joined = found.select("row", "doc_id", *own, base.alias("base")).join(extra, F.col("row") == F.col("at"), "left")
    return joined.select("doc_id", *own, "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    state = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        between = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        fresh = F.concat(acc["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, rest)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with personal data in the text replaced; null texts stay null.

    The fixed forms are found again beside the text; only what the patterns add is joined, by id and digest of the text, so
    positions never come from another text of that id, and rows without an id lose nothing.
    """
    found = personal_data(docs, id_col, text_col, digests=True)
    more = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.array_except("spans", "base").alias("more"))
    more = more.where(F.size("more") > 0).groupBy("__id", "__digest").agg(F.min("more").alias("__more"))
    base = F.transform(base_spans(F.col(text_col)), lambda x: F.struct(x["start"], x["no"], x["end"], x["kind"]))
    none = F.expr("cast(array() AS array<struct<start: long, no: int, end: long, kind: string>>)")
    same = docs[id_col].cast("long").eqNullSafe(more["__id"]) & (_digest(docs[text_col]) == more["__digest"])
    joined = docs.join(more, same, "left").withColumn("__spans", F.array_sort(F.concat(base, F.coalesce("__more", none))))
    return joined.withColumn(text_col, redacted(F.col(text_col), F.col("__spans"))).select(*docs.columns)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op5_pii")
def op5_pii(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
