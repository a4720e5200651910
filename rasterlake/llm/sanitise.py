"""Personal data by pattern, and terms that give it away by corpus co-occurrence.

Base spans are e-mail and IP addresses, card and phone numbers. The words of a document with a base span, outside of all
its spans, are candidates: with document counts over the whole corpus, ``PMI(term; kind) = log2(df(term with kind) *
documents / (df(term) * df(kind)))`` tells how many bits about the presence of a protected entity the term discloses, out
of the ``-log2(df(kind) / documents)`` bits that there are. A term that discloses at least the share ``DISCLOSED`` of them
(together with the kind in at least ``SUPPORT`` documents) is sensitive: its occurrences outside of base spans, in every
document, are spans of kind ``term``. ``sanitised`` generalises them to their shape and removes those that disclose more
than ``REMOVED``.

Every pattern is written without backtracking over long runs, with the same matches. Only words whose hash is in a bitmap
of the candidates are counted over the corpus, and only those in a bitmap of the sensitive terms are placed in the texts,
so few rows move; the following joins make both exact.

Defined cases: a null text is empty (no spans; the hash of the empty string); repeated rows are documents of their own;
an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.llm.bitmap import bitmap, bucket, holds
from rasterlake.llm.rows import numbered
from rasterlake.session import cut

KINDS = ("email", "ip", "card", "phone")
DISCLOSED = 0.75
REMOVED = 0.95
SUPPORT = 3
WORD = r"[\p{L}\p{N}]+"
SPAN = "\ue000"  # stands for a span; one in a text is a space beside it

_LOCAL = r"A-Za-z0-9._%+-"
#: the patterns of the four kinds; possessive where nothing that follows could use a shorter run, and started only at
#: the head of a run or where the last match ended
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without this has no match
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _found(text: Column, pattern: str, valid) -> Column:
    """[start, end) of the valid matches, in order, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["match"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(valid(p["match"]), F.array_append(acc["got"], span)).otherwise(acc["got"]).alias("got"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("got")), step, lambda acc: acc["got"])


def _of_kind(i: int, s: Column) -> Column:
    return F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is_kind(i: int, s: Column) -> Column:
    return s["kind"] == i


def base_spans(text: Column) -> Column:
    """All base spans as an array of (kind number, start, end), by kind, then start."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    parts = []
    for i, kind in enumerate(KINDS):
        found = _found(text, PATTERNS[kind], partial(_valid, kind))
        named = F.transform(found, partial(_of_kind, i))
        parts.append(F.when(text.contains("@") if kind == "email" else text.rlike(NEEDED[kind]), named).otherwise(none))
    return F.concat(*parts)


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    words = F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+"))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w != ""))


def _outside(text: Column, spans: Column) -> Column:
    """The text without its spans and the words that reach into one."""
    text = F.translate(text, SPAN, " ")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, F.lit(SPAN)).alias("out"))

    marked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]*+(?:{SPAN}[\p{{L}}\p{{N}}]*+)++", " ")


def _candidates(base: DataFrame) -> DataFrame:
    """(kind, term, both): documents that hold the kind and, outside all spans, the term."""
    hit = base.filter(F.size("spans") > 0)
    words = hit.select(_kinds(), F.explode(_words(_outside(F.col("text"), F.col("spans")))).alias("term"))
    return words.select(F.explode("kinds").alias("kind"), "term").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("both"))


def _kinds() -> Column:
    return F.array_distinct(F.transform("spans", lambda s: s["kind"])).alias("kinds")


def _places(text: Column, wanted: Column) -> Column:
    """(start, end, term) of the words of the whole text whose hash is in the bitmap."""
    tokens = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,term:string>>")

    def step(acc: Column, t: Column) -> Column:
        term, end = F.lower(t), acc["at"] + F.length(t)
        place = F.struct(acc["at"].alias("start"), end.alias("end"), term.alias("term"))
        return F.struct(end.alias("at"), F.when(holds(wanted, bucket(term)), F.array_append(acc["got"], place)).otherwise(acc["got"]).alias("got"))

    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("got")), step, lambda acc: acc["got"])


def _occurrences(base: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, start, end, disclosed) of the sensitive terms in all texts, outside all base spans."""
    risky = cut(terms.groupBy("term").agg(F.max("disclosed").alias("disclosed")))
    wanted = F.broadcast(bitmap(risky.select(bucket(F.col("term")).alias("id")), "wanted"))  # one row of fixed size
    placed = base.crossJoin(wanted).select("row", "spans", F.explode(_places(F.col("text"), F.col("wanted"))).alias("w"))
    clear = ~F.exists("spans", lambda s: (s["start"] < F.col("w.end")) & (F.col("w.start") < s["end"]))
    return placed.filter(clear).select("row", "w.start", "w.end", "w.term").join(risky, "term")


def sensitive_terms(base: DataFrame) -> DataFrame:
    """(kind, term, disclosed): candidates that disclose at least ``DISCLOSED`` of what there is to know."""
    pairs = cut(_candidates(base).filter(F.col("both") >= SUPPORT))
    wanted = F.broadcast(bitmap(pairs.select(bucket(F.col("term")).alias("id")), "wanted"))  # one row of fixed size
    counted = base.select(F.explode(_words(F.col("text"))).alias("term")).crossJoin(wanted).filter(holds(F.col("wanted"), bucket(F.col("term"))))
    terms = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kinds = base.select(_kinds()).select(F.explode("kinds").alias("kind"))
    kinds = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))  # one row per kind
    total = base.agg(F.count(F.lit(1)).alias("documents"))  # one row
    joined = pairs.join(terms, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(total))
    pmi = F.log2(F.col("both") * F.col("documents") / (F.col("df") * F.col("of_kind")))
    content = -F.log2(F.col("of_kind") / F.col("documents"))
    share = F.when(content > 0, pmi / content).otherwise(0.0)
    return cut(joined.select("kind", "term", share.alias("disclosed")).filter(F.col("disclosed") >= DISCLOSED))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, spans, terms) of every row; terms: array of (start, end, disclosed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    # written with the text, whose row number must not change between the passes
    base = cut(rows.select("row", "doc_id", "text", base_spans(F.col("text")).alias("spans")))
    hits = _occurrences(base, sensitive_terms(base))
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosed"))).alias("terms"))  # of one text
    none = F.array().cast("array<struct<start:int,end:int,disclosed:double>>")
    return base.drop("text").join(by_row, "row", "left").withColumn("terms", F.coalesce("terms", none))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds and the places of all spans."""
    found = _spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(F.filter("spans", partial(_is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans replaced by ``<kind>``, sensitive terms by their shape, or removed."""
    base = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    found = _spans(base.select("row", "doc.text"), "row", "text").select(F.col("doc_id").alias("row"), "spans", "terms")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    marks = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put")))
    shape = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosed"] > REMOVED, "").otherwise("<term>").alias("put")))
    edits = F.array_sort(F.concat(marks, shape))
    text = F.coalesce("doc.text", F.lit(""))

    def step(acc: Column, e: Column) -> Column:
        start = F.greatest(acc["at"], e["start"])  # spans of two kinds may overlap
        kept = F.substr(text, acc["at"] + 1, start - acc["at"])
        return F.struct(F.greatest(acc["at"], e["end"]).alias("at"), F.concat(acc["out"], kept, e["put"]).alias("out"))

    whole = F.aggregate(edits, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return base.join(found, "row").select("doc.doc_id", whole.alias("text"))
