"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

Of a text's word shingles (five words; a shorter text is one shingle) the sketch keeps
every 64-bit hash below a fixed fraction of the hash range, and always the smallest
hash, so that no sketch is empty. It is merged by a union (cut again to the hashes
below the fraction or the smallest), it grows with the text, and so estimates how much
of a short text lies in a very long one, which sketches of fixed size can't.

Words are hashed, and shingles are hashes of their words' hashes, all by XXH64. As a
string a fingerprint is its sorted hashes in hexadecimal with commas between.

Defined cases: null and empty texts have the fingerprint of a text without words, like
each other and unlike all others; equal texts have equal fingerprints; rows with equal
ids are documents of their own, in the order of their texts; null ids come last in
descending order; a single document is its own next; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import SPACE

#: Words in a shingle, and one of how many hashes is kept.
WORDS, SCALED = 5, 8
#: Quantiles of the ids that their spans follow.
QUANTILES = 64


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kept(hashes: Column, scaled: int) -> Column:
    bound = (1 << 63) // scaled * 2 - (1 << 63) if scaled > 1 else (1 << 63) - 1
    return once(hashes, lambda h: F.sort_array(F.array_union(F.array(F.array_min(h)), F.filter(h, lambda x: x < bound))))


def sketch(text: Column, words: int = WORDS, scaled: int = SCALED) -> Column:
    """Sorted hashes (array<long>) of a text's sketch; never empty, never null."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")
    hashed = F.transform(found, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        # get() is null past the end, and xxhash64 passes over nulls.
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    return _kept(once(hashed, shingles), scaled)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def merge(a: Column, b: Column, scaled: int = SCALED) -> Column:
    """The sketch of both texts' shingles."""
    return _kept(F.array_union(a, b), scaled)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sketch) for each row of ``docs``."""
    return docs.select(id_col, sketch(F.col(text_col)).alias("sketch"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_span: int = 500) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch), next by descending id; after the last comes the first.

    Ids are dealt into spans: between approximate quantiles, so that far ids don't crowd
    the others, and evenly inside those. They are followed inside each span, and the
    text is shuffled once. The last row of each span is sent on to the span above it.
    """
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    marks, n = docs.agg(F.percentile_approx(id_col, shares, 10_000), F.count(F.lit(1))).first()
    marks = sorted({float(m) for m in marks or []})
    inside = max(1, n // (per_span * QUANTILES))
    # As doubles, which the whole range of long ids fits; spans need only keep the order.
    number = F.col(id_col).cast("double")
    if len(marks) > 1 and n > per_span:
        bounds = F.array(*map(F.lit, marks))
        part = F.least(F.size(F.filter(bounds, lambda m: m <= number)), F.lit(len(marks) - 1))
        low, high = F.get(bounds, F.greatest(part - 1, F.lit(0))), F.get(bounds, F.greatest(part, F.lit(1)))
        place = F.least(F.greatest(F.floor((number - low) / (high - low) * inside), F.lit(0)), F.lit(inside - 1))
        span = F.coalesce(part * inside + place, F.lit(-1)).cast("long")
    else:
        span = F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), span.alias("span")).repartition("span")
    order = Window.partitionBy("span").orderBy(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    # To which span each span's last row goes: the next between its quantiles, else the first of the next ones.
    every = docs.select(span.alias("span")).distinct().withColumn("part", F.floor(F.col("span") / inside))
    one = Window.partitionBy(F.lit(0))  # a row for each quantile
    firsts = every.groupBy("part").agg(F.min("span").alias("first"))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(one.orderBy("first")), F.min("first").over(one)).alias("beyond"))
    above = every.withColumn("to", F.lead("span").over(Window.partitionBy("part").orderBy("span"))).join(firsts, "part")
    above = above.select("span", F.coalesce("to", "beyond").alias("to"))
    ends = rows.withColumn("below", F.lead("span").over(order)).filter(F.col("below").isNull()).join(above, "span")
    ends = ends.select(F.col("to").alias("span"), F.struct("text", sketch(F.col("text")).alias("sketch")).alias("end"))
    follow = rows.withColumn("sketch", sketch(F.col("text"))).withColumn("next", F.lag(F.struct("text", "sketch")).over(order))
    joined = follow.join(ends, "span", "left").withColumn("next", F.coalesce("next", "end"))
    return joined.select("id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next document are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document by descending id.
    """
    rows = with_next(docs, id_col, text_col)
    text, cut = F.coalesce("text", F.lit("")), F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length(text).cast("long"))
    edited = F.concat(F.substring(text, F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
