"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source's target is met by whole
repeats of all its documents plus the documents whose hash lies below a
threshold. Thresholds come from histograms: sizes are summed by source and
hash bucket, the running sum finds the bucket in which the budget ends, and
only that bucket is refined by the next bits of the hash, until it holds one
hash. Nothing is sorted; a larger budget takes a superset (nested thresholds);
the same input gives the same mix.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Sources in code-point order, null
last, weigh ``weights`` in turn; a target stops at ``most`` times its source's
size and the excess is shared again by weight.

Defined results: null and blank texts have size 0; a source of size 0 has the
target 0; documents with the same id (repeated rows, null ids) are taken or
left together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and of them in one level of histograms.
HASH_BITS, LEVEL_BITS = 60, 12


def hash60(column: str) -> Column:
    """60 bits of the md5 of an id's text, the same in any engine."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sizes(documents: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return documents.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), hash60(id_column).alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...], most: float, share: float) -> DataFrame:
    """source, source_size, target: the water level L with sum(min(most * size, L * weight)) = budget.

    Sources are ordered by the level at which each is full; the first one that
    isn't full at the level its predecessors leave fixes the level. The windows
    over all rows see one row per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.row_number().over(in_order).alias("place"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("w", w).withColumn("full", most * F.col("source_size"))
    table = table.withColumn("level", F.col("full") / F.col("w"))
    every, filling = Window.partitionBy(), Window.orderBy("level", "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    table = table.withColumn("reach", left / weight_left)
    table = table.withColumn("water", F.min(F.when(F.col("reach") <= F.col("level"), F.struct("level", "place", "reach"))).over(every)["reach"])
    return table.select("source", "source_size",
                        F.least(F.col("full"), F.coalesce(F.col("water") * F.col("w"), F.col("full"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, cutoff: documents with hash < cutoff sum to about ``rest`` words.

    ``budgets`` has one row per source (source, rest > 0). Each level reads only
    the documents in the buckets where the budgets end."""
    state = budgets.select("source", "rest", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("bucket"))
    open_docs, found = sized.where("size > 0"), None
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        parent, bucket = F.shiftright("h", HASH_BITS - bits + LEVEL_BITS), F.shiftright("h", HASH_BITS - bits)
        inside = open_docs.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (
            parent == F.col("s.bucket"))).select("d.*", "rest", "below")
        hist = inside.groupBy("source", "rest", "below", bucket.alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
        run = F.col("below") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        ends = hist.withColumn("upto", run).where("upto >= rest and upto - n < rest")
        ends = stored(ends.select("source", "rest", (F.col("upto") - F.col("n")).alias("below"), "bucket", "upto", "first", "last"),
                      "mix-buckets")
        # one hash left: it comes in if that is nearer to the budget
        take = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("below")
        one = ends.where("first = last").select("source", F.when(take, F.col("last") + 1).otherwise(F.col("first")).alias("cutoff"))
        found = one if found is None else found.unionByName(one)
        state = ends.where("first < last")
        if state.isEmpty():
            break
    return found


def plan_mix(sized: DataFrame, weights: tuple[int, ...], most: float, share: float) -> DataFrame:
    """source, source_size, target, rounds (repeats of every document) and cutoff (documents
    with a hash below it come once more); one row per source."""
    plan = targets(sized, weights, most, share)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("rounds", rounds.cast("bigint"))
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-targets")
    cut = thresholds(sized, plan.where("rest > 0"))
    # a budget beyond the last hash (rounding) takes all
    none = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.*", F.coalesce("cutoff", none).alias("cutoff"))
    return stored(plan, "mix-plan")


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    sized = stored(sizes(documents, id_column, text_column, source_column), "mix-sizes")
    plan = plan_mix(sized, weights, most, share)
    return sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.source", "size", "source_size", "target",
        (F.col("size") * (F.col("rounds") + (F.col("h") < F.col("cutoff")).cast("bigint"))).alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0,
                    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``documents`` as the mix takes them: rows repeated or left out."""
    sized = stored(sizes(documents, id_column, text_column, source_column), "mix-sizes")
    plan = plan_mix(sized, weights, most, share).select(F.col("source").alias("p_source"), "rounds", "cutoff")
    names = documents.columns
    rows = documents.select(F.struct("*").alias("row"), F.col(source_column).cast("string").alias("d_source"), hash60(id_column).alias("h"))
    rows = rows.join(plan, F.col("d_source").eqNullSafe(F.col("p_source")))
    times = (F.col("rounds") + (F.col("h") < F.col("cutoff")).cast("bigint")).cast("int")
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("time"))
    return rows.select(*[F.col("row")[n].alias(n) for n in names])


def oracle_sql(weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> str:
    """The same mix for an engine that sorts by hash instead."""
    w = " ".join(f"WHEN {i} THEN {float(x)}" for i, x in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
f AS (
  SELECT *, {most} * source_size AS "full", {most} * source_size / w AS level
  FROM (SELECT *, CASE (place - 1) % {len(weights)} {w} END::DOUBLE AS w FROM s)),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum("full") OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM f),
t AS (
  SELECT source, source_size, least("full", coalesce((SELECT arg_min(reach, level) FROM r WHERE reach <= level) * w, "full"))::DOUBLE AS target FROM r),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
b AS (
  SELECT *, target - rounds * source_size AS rest FROM p),
g AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d WHERE size > 0 GROUP BY source, h),
c AS (
  SELECT b.source, CASE WHEN upto - rest <= rest - (upto - n) THEN h + 1 ELSE h END AS cutoff
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source WHERE rest > 0 AND upto >= rest AND upto - n < rest)
SELECT d.doc_id, d.source, d.size, b.source_size, b.target,
       (d.size * (b.rounds + CASE WHEN d.h < coalesce(c.cutoff, CASE WHEN b.rest > 0 THEN {1 << HASH_BITS} ELSE 0 END) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source"""
