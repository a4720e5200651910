"""I-Match fingerprints.

Terms are the runs of letters and digits of the lower-case text, each known by its 64-bit hash. Document
frequencies are counted over all documents; the lexicon keeps the terms whose share of documents lies in a band, so of
inverse document frequency between ``-log2(HIGH)`` and ``-log2(LOW)``. A document's distinct lexicon terms are sorted and
hashed once for each of several randomised sub-lexicons. The fingerprint is the list of these hashes; the likeness of two
is the share of equal entries among those that are set in either.

The lexicon has at most (mean distinct terms of a document) / LOW terms whatever the number of documents, and is passed on
in one row as a table of hashes by their last bits. The next document by falling id is found without moving a text twice: rows go once to buckets
of neighbouring ids, and the first row of each bucket is also copied into the bucket before it.

Defined cases: a null text is empty; a text without lexicon terms has a fingerprint of dashes, and two such are alike only
if their terms are the same (none at all, or the same ones outside the lexicon);
a null id comes last; rows of one id follow by the hash of their text; of a table with one row the next document is that
row itself; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.llm.rows import partitions
from rasterlake.session import cut

LOW, HIGH = 0.002, 0.6
#: (k, n): the lexicon is dealt by a seeded hash into 2**k parts, and n of them are sub-lexicons; all 16 parts of the
#: first split together are the lexicon, the finer ones outlast more edits
SUB_LEXICONS = ((4, 16), (6, 6), (8, 6))
NONE = "--------"
SLOTS = 14  # bits of a hash that tell where the lexicon keeps it


def term_ids(text: Column) -> Column:
    """Distinct term ids of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    ids = F.transform(words, lambda w: F.when(w != "", F.xxhash64(w)))
    return F.array_compact(F.array_distinct(ids))


def _slot(i: Column) -> Column:
    return i.bitwiseAND((1 << SLOTS) - 1).cast("int")


def lexicon_table(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row: the lexicon as an array of the hashes of each slot (null where it has none)."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    ids = texts.select(words).filter("word != ''").select(F.xxhash64("word").alias("id"))
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    share = F.col("df") / F.greatest(F.col("n"), F.lit(1))
    band = counts.crossJoin(F.broadcast(texts.agg(F.count(F.lit(1)).alias("n")))).filter((share >= low) & (share <= high))  # one row
    used = cut(band.groupBy(_slot(F.col("id")).alias("slot")).agg(F.collect_list("id").alias("ids")))  # a few of the bounded lexicon
    slots = texts.sparkSession.range(1 << SLOTS).select(F.col("id").cast("int").alias("slot"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "ids")))  # as many entries as there are slots
    return cut(slots.join(used, "slot", "left").agg(F.transform(ordered, lambda e: e["ids"]).alias("lexicon")))


def lexicon_terms(ids: Column, lexicon: Column) -> Column:
    """The sorted distinct terms that the lexicon keeps."""
    return F.array_sort(F.filter(ids, lambda i: F.array_contains(F.get(lexicon, _slot(i)), i)))


def _part(k: int, i: Column) -> Column:
    return F.hash(i, F.lit(k)).bitwiseAND((1 << k) - 1)


def _in_used(k: int, n: int, i: Column) -> Column:
    return _part(k, i) < n


def _in_part(k: int, part: int, i: Column) -> Column:
    return _part(k, i) == part


def _hashes(texts: DataFrame, terms: str, name: str) -> DataFrame:
    """Replaces the column of terms by the hashes of the sub-lexicons, ``NONE`` where the text has no term of one.

    The terms of the sub-lexicons of one size are a column of their own, so that each step is taken once.
    """
    used = texts.withColumns({f"{name}_{k}": F.filter(terms, partial(_in_used, k, n)) for k, n in SUB_LEXICONS})
    parts = [F.array_join(F.filter(f"{name}_{k}", partial(_in_part, k, p)), ",") for k, n in SUB_LEXICONS for p in range(n)]
    hashed = F.transform(F.array(*parts), lambda t: F.when(t == "", NONE).otherwise(F.substring(F.sha2(t, 256), 1, 8)))
    return used.withColumn(name, hashed).drop(terms, *[f"{name}_{k}" for k, _ in SUB_LEXICONS])


def _bare(ids: Column, terms: Column) -> Column:
    """What tells a text without lexicon terms from others: all its terms."""
    return F.when(F.size(terms) == 0, F.sha2(F.array_join(F.array_sort(ids), ","), 256))


def _likeness(a: Column, b: Column, bare_a: Column, bare_b: Column) -> Column:
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != NONE)))
    return F.when(either == 0, (bare_a == bare_b).cast("double")).otherwise(same / either)


def _buckets(docs: DataFrame) -> Column:
    """The bucket of an id: buckets hold about as many rows each, in id order."""
    n = 4 * partitions(docs)
    shares = [i / n for i in range(1, n)]
    row = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100 * n)).alias("p")).first()
    ends = sorted(set(row[0] or []))
    step = max(1, int(len(ends) ** 0.5))
    coarse, fine = ends[step::step], [ends[i : i + step] for i in range(0, len(ends), step)]
    if not ends:
        return F.lit(0)
    group = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda e: e <= F.col("doc_id"))) if coarse else F.lit(0)
    inner = F.filter(F.get(F.array(*[F.array(*map(F.lit, f)) for f in fine]), group), lambda e: e <= F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(group * step + F.size(inner))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: fingerprints of the text and of the edited text, and their likeness."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bucket = _buckets(texts)
    placed = texts.select("doc_id", "text", F.xxhash64("text").alias("h"), bucket.cast("int").alias("bucket"))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h")
    # at most one row per bucket; the first of all buckets follows the last
    heads = placed.groupBy("bucket").agg(F.max(order).alias("head"))
    last = F.min("bucket").over(Window.partitionBy(F.lit(0)))
    ghosts = cut(heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(Window.orderBy(F.desc("bucket"))), last).alias("to")))
    ghosts = ghosts.select(F.col("bucket").alias("b"), F.col("head.doc_id").alias("d"), F.col("head.h").alias("g"), "to")
    hit = (placed["bucket"] == ghosts["b"]) & placed["doc_id"].eqNullSafe(ghosts["d"]) & (placed["h"] == ghosts["g"])
    both = placed.join(F.broadcast(ghosts), hit, "left")
    where = F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), F.lit(True).alias("ghost")))))
    lexicon = F.broadcast(lexicon_table(texts, low, high))  # one row of bounded size
    # the terms are a column of their own, so that they are found once and not for each sub-lexicon
    own = both.crossJoin(lexicon).select("doc_id", "text", "h", where.alias("where"), "lexicon", term_ids(F.col("text")).alias("ids"))
    own = own.select("doc_id", "text", "h", "where", "ids", lexicon_terms(F.col("ids"), F.col("lexicon")).alias("terms"))
    own = own.withColumn("bare", _bare(F.col("ids"), F.col("terms"))).drop("ids")
    own = _hashes(own, "terms", "mine").withColumn("w", F.explode("where"))
    w = Window.partitionBy("at").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("h"))
    following = own.select("doc_id", "text", "mine", "bare", "h", "w.at", "w.ghost").select(
        "doc_id", "text", "mine", "bare", "ghost", F.lead("text").over(w).alias("next"), F.lead("mine").over(w).alias("next_mine"), F.lead("bare").over(w).alias("next_bare")
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half))
    rows = following.filter("not ghost").select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "mine", "next_mine", "bare", "next_bare")
    done = rows.crossJoin(lexicon).withColumn("ids", term_ids(F.col("edited")))
    done = done.withColumn("terms", lexicon_terms(F.col("ids"), F.col("lexicon"))).drop("lexicon")
    done = done.withColumn("their_bare", _bare(F.col("ids"), F.col("terms"))).drop("ids")
    done = _hashes(done, "terms", "theirs")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("mine", "").alias("fingerprint"), F.array_join("theirs", "").alias("edited_fingerprint"),
        _likeness(F.col("mine"), F.col("theirs"), F.col("bare"), F.col("their_bare")).alias("near_edited"),
        _likeness(F.col("mine"), F.col("next_mine"), F.col("bare"), F.col("next_bare")).alias("near_next"),
    )
