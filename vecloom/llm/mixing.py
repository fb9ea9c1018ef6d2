"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source has a target share of all words. Its documents expect target / size copies
each; these are prefix-summed in a fixed order within the source, one random offset is
added, and a document is emitted once for each integer boundary that its span of the
sum crosses. The order runs by size first (in steps of an eighth or finer), so that the
sample has the source's own mixture of short and long documents and its words come near
the target.

The prefix sum is not one task's work: a source's documents are dealt into buckets by
size class and a hash of their id, ranked within their bucket, and moved on by the
bucket's place in its source. A bucket's count comes from a pre-aggregation, and a
source that holds a third of all rows is spread over thousands of buckets.

Defined cases: null and empty texts have size 0 and are emitted like other documents; a
null source is a source of its own, last in order; repeated ids are documents of their
own, in the order of a hash of their texts; a source without words has target 0 and emits nothing; an empty table gives an
empty result. Further columns are carried along; internal names start with ``__mix_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import word_count

#: Weights of the sources in order, repeating, and how many times its own size a target may be.
WEIGHTS, MOST = (1, 2, 3), 3
#: Hash buckets of each size class of a source.
FAN_OUT = 256


def _hash(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 sum, as a number."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with their weight and target added.

    Targets share the sum of sizes by weight; none exceeds ``most`` times its source's
    size, and what is above goes to the others by weight until none is above. That end
    is reached at once by ordering sources by the level at which they are full: one is
    full if its level is no higher than what remains for it and all after it, per weight.
    """
    one = Window.partitionBy(F.lit(0))  # a row for each source
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("full", F.col("source_size") * most)
    fill = one.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("full").over(before), F.lit(0))
    level = left / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", level).withColumn("is_full", F.col("full") / F.col("weight") <= F.col("level"))
    # The first source that isn't full sets the level of all that aren't.
    shared = F.min(F.when(~F.col("is_full"), F.struct((F.col("full") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(one)["level"]
    return w.select("source", "source_size", "weight", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(shared * F.col("weight")).alias("target"))


def plan(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with the columns __mix_size, __mix_source_size, __mix_target and __mix_copies."""
    size = word_count(F.col(text_col))
    rows = docs.withColumn("__mix_size", size).withColumn("__mix_tie", F.xxhash64(text_col))
    bits = F.length(F.bin("__mix_size"))
    # A class for each power of two and the three bits that follow the first.
    step = F.expr("shiftright(__mix_size, cast(greatest(length(bin(__mix_size)) - 4, 0) as int))")
    rows = rows.withColumn("__mix_class", bits * 16 + step).withColumn("__mix_hash", _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 8) % FAN_OUT)
    keys = ["__mix_class", "__mix_hash"]
    buckets = rows.groupBy(F.col(source_col).alias("source"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__mix_size").alias("words"))
    before = Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # Both uses of the buckets ask for both sums, so that Spark aggregates once and reuses the exchange.
    offsets = buckets.filter("words >= 0").select("source", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_before"))
    sizes = targets(buckets.filter("n > 0").groupBy("source").agg(F.sum("words").alias("source_size")))
    start = _hash(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))), 8) / F.lit(2.0**32)
    sizes = sizes.select(
        F.col("source").alias("__mix_source"),
        F.col("source_size").alias("__mix_source_size"),
        F.col("target").alias("__mix_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__mix_rate"),
        start.alias("__mix_start"),
    )
    offsets = offsets.withColumnsRenamed({"source": "__mix_s", **{k: f"{k}_" for k in keys}})
    ranked = rows.withColumn("__mix_rank", F.row_number().over(Window.partitionBy(source_col, *keys).orderBy("__mix_size", id_col, "__mix_tie")))
    same = F.col(source_col).eqNullSafe(F.col("__mix_s"))
    for k in keys:
        same &= F.col(k) == F.col(f"{k}_")
    ranked = ranked.join(offsets, same).join(sizes, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    upto = lambda n: F.floor(F.col("__mix_start") + F.col("__mix_rate") * n)
    n = F.col("__mix_before") + F.col("__mix_rank")
    copies = F.least(upto(n) - upto(n - 1), F.ceil("__mix_rate"))
    return ranked.withColumn("__mix_copies", copies).select(*docs.columns, "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies")


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = plan(docs, seed, id_col, text_col, source_col).filter("__mix_copies > 0")
    return taken.withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)


def taken(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    out = plan(docs.select("doc_id", "source", "text"), seed)
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"))


#: The same over a table {docs} for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
k AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 256 AS hash FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS filled FROM s),
l AS (SELECT *, filled / weight AS full_at, (sum(source_size) OVER () - coalesce(sum(filled) OVER f, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM w
    WINDOW f AS (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN full_at <= level THEN filled::DOUBLE
    ELSE (SELECT arg_min(level, full_at) FROM l WHERE full_at > level) * weight END AS target FROM l),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('42/' || coalesce('=' || k.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY k.source ORDER BY class, hash, size, doc_id NULLS FIRST) AS n
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (least(floor(start + rate * n) - floor(start + rate * (n - 1)), ceil(rate)) * size)::BIGINT AS taken FROM r
"""
