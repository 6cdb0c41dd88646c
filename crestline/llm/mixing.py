"""Mixing sources to target weights (operator 5), DataFrame functions only.

Sources by code point, null last, weigh 5, 2, 1 and so on; they share all words by weight, none above ``cap`` times its own size
(the excess goes to the others by weight). Each document has a hash-random key. A source's keys are split into ranges of a few
hundred rows, as many as the source needs, so no source is ordered in one task; a range's words are summed first, the sums added up
over ranges, and only then over the rows of a range. A source takes whole epochs and then the documents in key order
up to its exact budget; the document at the cut is taken in part.

Defined results: a null text counts as empty, and a document without words takes 0; repeated rows are rows of their own; sources may be null;
an empty table gives no rows; other columns of the input don't matter whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.llm.common import WORD, row_order, running, text_or_empty, whole_row
from crestline.session import Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
RANGE_ROWS = 400
BROADCAST_SOURCES = 100_000
BIG = "decimal(38,0)"


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))


def _sized(docs: DataFrame, seed: int) -> list[Column]:
    """The operator's own columns of docs, under names that nothing else uses."""
    size = F.regexp_count(text_or_empty(docs), F.lit(WORD)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))  # never null: joins and windows treat it alike
    return [docs["doc_id"].alias("__doc"), source.alias("__source"), size.alias("__size"), _key(docs["doc_id"], seed).alias("__key")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """__source, source_size and target of each source; sizes has a row for each source."""
    everything = W.partitionBy()
    order = W.orderBy((F.col("__source") == "").cast("int"), "__source")  # rows are sources
    ranked = sizes.withColumn("turn", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") + 1).cast("int"))
    product = 1
    for w in weights:
        product *= w
    ranked = ranked.withColumn("w", weight.cast(BIG)).withColumn("top", (F.col("source_size") * cap).cast(BIG))
    by_level = W.orderBy((F.col("top") * F.lit(product) / F.col("w")).cast(BIG), "__source")
    levels = (
        ranked.withColumn("all", F.sum(F.col("source_size").cast(BIG)).over(everything))
        .withColumn("tops", F.sum("top").over(by_level.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("top"))
        .withColumn("rest", F.sum("w").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        # Capped if the common level, at which this source is just full, needs no more than there is.
        .withColumn("full", (F.col("all") - F.col("tops")).cast("decimal(30,0)") * F.col("w").cast("decimal(8,0)") >= F.col("top").cast("decimal(27,0)") * F.col("rest").cast("decimal(11,0)"))
    )
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(everything), F.lit(0).cast(BIG))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    share = F.col("left").cast("double") * F.col("w").cast("double") / F.col("open").cast("double")
    return levels.withColumn("left", left).withColumn("open", open_weight).select(
        "__source", "source_size", F.when(F.col("full"), F.col("top").cast("double")).otherwise(share).alias("target")
    )


def _taken(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], cap: int, range_rows: int, run: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """rows with source_size, target, taken and copies, and the tables that this reads. sized: the rows' own columns, written."""
    ranges = sized.groupBy("__source").agg(F.ceil(F.count("*") / range_rows).alias("__ranges"))
    ranges = run.put(ranges.select(F.col("__source").alias("__of"), "__ranges"), "ranges")  # a row for each source
    sums = _ranged(sized, ranges).groupBy("__source", "__range").agg(F.sum("__size").alias("__words"))
    sums = run.put(sums, "sums")
    goal = targets(sums.groupBy("__source").agg(F.sum("__words").alias("source_size")), weights, cap)
    offsets = running(sums, "__source", "__range", "__words", "__before").join(goal, "__source").select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), "__before", "source_size", "target")
    rows = _ranged(rows, ranges)
    within = W.partitionBy("__source", "__range").orderBy("__key", "__doc", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__upto", F.sum("__size").over(within))
    rows = rows.join(offsets, (F.col("__source") == F.col("__s")) & (F.col("__range") == F.col("__r")))
    budget = F.floor(F.col("target")).cast("long")
    rows = rows.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    part = F.least(F.greatest(budget - F.col("__epochs") * F.col("source_size") - (F.col("__before") + F.col("__upto") - F.col("__size")), F.lit(0)), F.col("__size"))
    rows = rows.withColumn("__part", part)
    whole = F.col("__epochs") + F.when((F.col("__size") > 0) & (2 * F.col("__part") >= F.col("__size")), 1).otherwise(0)
    return rows.withColumn("taken", F.col("__epochs") * F.col("__size") + F.col("__part")).withColumn("copies", F.when(F.col("__size") > 0, whole).otherwise(0).cast("long")), [ranges, sums]


def _ranged(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with __range: which of its source's equal ranges the key is in, by its first 28 bits."""
    place = F.conv(F.substring("__key", 1, 7), 16, 10).cast("long") * F.col("__ranges") / F.lit(1 << 28)
    return rows.join(ranges, F.col("__source") == F.col("__of")).withColumn("__range", F.floor(place).cast("long")).drop("__of", "__ranges")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies (whole documents nearest to what is taken) of every row."""
    with Scratch() as run:
        sized = run.put(docs.select(*_sized(docs, seed)), "sizes")
        out, read = _taken(sized, sized, weights, cap, range_rows, run)
        return run.leave(out.select(F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "taken", "copies"), sized, *read)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as whole documents are taken (the one at a cut if at least half of it is). The cut of each source is
    found on keys and sizes alone and sent to the documents, so texts aren't shuffled."""
    place = F.struct("__key", "__doc", "__size")
    with Scratch() as run:
        sized = run.put(docs.select(*_sized(docs, seed)), "sizes")
        taken, _ = _taken(sized, sized, weights, cap, range_rows, run)
        once_more = F.col("copies") > F.col("__epochs")
        cuts = taken.groupBy(F.col("__source").alias("__of")).agg(F.max("__epochs").alias("__whole"), F.max(F.when(once_more, place)).alias("__last"))
        cuts = run.put(cuts, "cuts")
        # Rows that repeat the last one: as many of them are taken once more as the budget has left.
        ends = taken.join(cuts.select("__of", "__last"), F.col("__source") == F.col("__of")).filter(place == F.col("__last"))
        ends = ends.groupBy(F.col("__source").alias("__at")).agg(F.count("*").alias("__all"), F.sum(once_more.cast("long")).alias("__some"))
        cuts = run.put(cuts.join(ends, F.col("__of") == F.col("__at"), "left").drop("__at"), "ends")
        few = cuts.count() <= BROADCAST_SOURCES
        rows = docs.select(*_sized(docs, seed), whole_row(docs), row_order(docs).alias("__more"))
        rows = rows.join(F.broadcast(cuts) if few else cuts, F.col("__source") == F.col("__of")).filter("__size > 0")
        torn = (place == F.col("__last")) & (F.col("__some") < F.col("__all"))
        copies = F.col("__whole") + F.when(place <= F.col("__last"), 1).otherwise(0)
        out = rows.filter(~F.coalesce(torn, F.lit(False))).select("__row", copies.alias("__copies"))
        if not cuts.filter("__some < __all").isEmpty():
            nth = F.row_number().over(W.partitionBy("__source").orderBy("__more"))
            out = out.unionByName(rows.filter(torn).select("__row", (F.col("__whole") + F.when(nth <= F.col("__some"), 1).otherwise(0)).alias("__copies")))
        out = out.filter("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).select("__row.*")
        return run.leave(out, cuts)


def op5_query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}') AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS sz,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::HUGEINT AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, sum(sz) OVER () AS total,
    sum({CAP} * sz) OVER o - {CAP} * sz AS tops,
    sum(w) OVER (ORDER BY {CAP} * sz * 10 // w, coalesce('=' || source, '') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW o AS (ORDER BY {CAP} * sz * 10 // w, coalesce('=' || source, '') ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT *, (total - tops) * w >= {CAP} * sz * rest AS is_full FROM l
), g AS (
  SELECT source, sz::BIGINT AS sz,
    CASE WHEN is_full THEN ({CAP} * sz)::DOUBLE
      ELSE (total - coalesce(sum({CAP} * sz) FILTER (is_full) OVER (), 0))::DOUBLE * w::DOUBLE / (sum(w) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM f
), t AS (
  SELECT d.doc_id, d.size, g.sz, g.target, floor(g.target)::BIGINT AS budget,
    CASE WHEN g.sz > 0 THEN floor(g.target)::BIGINT // g.sz ELSE 0 END AS epochs,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT *, least(greatest(budget - epochs * sz - start, 0), size) AS part FROM t
)
SELECT doc_id, size, sz AS source_size, target, (epochs * size + part)::BIGINT AS taken,
  (CASE WHEN size > 0 THEN epochs + CASE WHEN 2 * part >= size THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS copies
FROM p
"""
