"""Exact dedup by content-defined chunk recipes (operator 8), DataFrame functions only.

A text's normal form (white space deleted) is cut where its content says so: a chunk ends at the first trigger after
``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest, so equal texts get equal chunks and an insertion moves few cuts.

1. A document becomes its recipe, the ordered list of its chunks' digests. Digests are counted; the bytes of chunks under digests that occur
   more than once (found by a sieve of bounded size, so unique chunks never move) are compared, smallest with largest under each digest. If each
   stands for one text, digests are verified identifiers; if any does not, the bytes themselves serve as identifiers.
2. Documents are equal when their lists of identifiers are. Only lists, lengths and ids are shuffled here, never texts.

One row of a group stays: that with the most code points, then the smallest doc_id (null last), then the smallest hash of its text; of rows equal in
all these the first in the written table of recipes. Defined results: a null text counts as empty, and all such rows are one group; of repeated
rows one stays, and rows that share a doc_id with different texts are judged each by its own text; an empty table gives no rows;
columns besides doc_id and text are ignored, except that drop_copies prefers the smallest values in them where all else is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import SPACE, Sieve, row_order, text_or_empty, whole_row
from crestline.session import Scratch

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Ends a chunk: any fixed pattern is correct; this one occurs about once in fifty characters of prose.
TRIGGER = r"[aeinorst][bcdfglmpuvy][aehilnortu][ghklmnw]"
#: The same deletion as SPACE, as single characters for byte-wise replacement.
BLANKS = " \t\n\x0b\x0c\r"


def normal_form(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def chunks(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{TRIGGER})|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def _identifiers(normal: Column) -> Column:
    return F.transform(chunks(normal), lambda chunk: F.unhex(F.sha2(chunk, 256)))


def _clash(docs: DataFrame, made: DataFrame, run: Scratch) -> bool:
    """Whether two different chunks anywhere have one digest. made: the recipes of docs."""
    marks = made.select(F.explode("recipe").alias("digest")).select(F.xxhash64("digest").alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    twice = run.put(marks.filter("n > 1").select("mark"), "twice")  # 8 bytes of a digest are enough to find those that can occur twice
    found = docs.select(F.explode(chunks(normal_form(text_or_empty(docs)))).alias("chunk")).select(F.unhex(F.sha2("chunk", 256)).alias("digest"), "chunk")
    found = Sieve.of(twice, F.col("mark")).marked(found, F.xxhash64("digest")).filter("__maybe")
    clash = not found.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a != b").isEmpty()
    run.drop(twice)
    return clash


def _rank(n_points: Column, doc_id: Column, mark: Column, *more: Column) -> Column:
    """The order in a group: the smallest stays."""
    return F.struct((-n_points).alias("n"), doc_id.isNull().alias("missing"), doc_id.alias("doc_id"), mark.alias("mark"), *[c.alias(f"c{i}") for i, c in enumerate(more)])


def recipes(docs: DataFrame, run: Scratch) -> tuple[DataFrame, bool]:
    """row, doc_id, n_points, mark, text_sha256 and recipe of each row, and whether recipes are bytes."""
    base = docs.select("doc_id", text_or_empty(docs).alias("raw"), normal_form(text_or_empty(docs)).alias("normal"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("raw").cast("long").alias("n_points"), F.xxhash64("raw").alias("mark"), F.sha2("normal", 256).alias("text_sha256"), "normal")
    made = run.put(base.select("*", _identifiers(F.col("normal")).alias("recipe")).drop("normal"), "recipes")
    if not _clash(docs, made, run):
        return made, False
    run.drop(made)
    return run.put(base.select("*", F.transform(chunks(F.col("normal")), lambda chunk: chunk.cast("binary")).alias("recipe")).drop("normal"), "recipes"), True


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    with Scratch() as run:
        made, _ = recipes(docs, run)
        best = F.min(_rank(F.col("n_points"), F.col("doc_id"), F.col("mark"), F.col("row"))).alias("best")
        groups = made.groupBy("recipe").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
        # Only groups of two or more are joined back, as a table of their own, and only to rows that a sieve lets through: the rows' side of that join
        # can be split however large a group is.
        groups = run.put(groups.select(F.col("recipe").alias("g_recipe"), F.col("best.doc_id").alias("keep_id"), F.col("best.c0").alias("keep_row"), "group_size"), "groups")
        rows = Sieve.of(groups, F.xxhash64("g_recipe")).marked(made, F.xxhash64("recipe"))
        alone = rows.filter("NOT __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        met = rows.filter("__maybe").join(groups, F.col("recipe") == F.col("g_recipe"), "left")
        keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
        met = met.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256")
        return run.leave(alone.unionByName(met), made, groups)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group. Rows of texts that occur once pass through a sieve and aren't shuffled; the rest is reduced by recipe, in
    each task first, so a group of any size sends one row from a task."""
    with Scratch() as run:
        made, bytes_ = recipes(docs, run)
        several = made.groupBy("recipe").agg(F.min("text_sha256").alias("sha"), F.count("*").alias("n")).filter("n > 1")
        several = run.put(several.select("sha"), "several")
        text = text_or_empty(docs)
        rows = docs.select(whole_row(docs), F.length(text).alias("__n"), docs["doc_id"].alias("__doc"), F.xxhash64(text).alias("__mark"), row_order(docs).alias("__more"), normal_form(text).alias("__normal"))
        rows = Sieve.of(several, F.xxhash64("sha")).marked(rows, F.xxhash64(F.sha2("__normal", 256)))
        alone = rows.filter("NOT __maybe").select("__row")
        recipe = F.transform(chunks(F.col("__normal")), lambda chunk: chunk.cast("binary")) if bytes_ else _identifiers(F.col("__normal"))
        met = rows.filter("__maybe").select("__row", _rank(F.col("__n"), F.col("__doc"), F.col("__mark"), F.col("__more")).alias("__rank"), recipe.alias("__recipe"))
        best = met.groupBy("__recipe").agg(F.min_by("__row", "__rank").alias("__row")).select("__row")
        return run.leave(alone.unionByName(best).select("__row.*"), several)


def op8_query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS normal FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY normal ORDER BY length(raw) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY normal) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY normal ORDER BY length(raw) DESC, doc_id) AS kept,
  sha256(normal) AS text_sha256
FROM t
"""
