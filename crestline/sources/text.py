"""Text sources: vectors, labels, decision graphs, label-first CSV, results, and key=value output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.session import keep

DELIMITERS = r"[\t;, \r\x00]+"
SOMETHING = r"[^\t;, \r\x00]"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """<id, value>: non-empty lines, numbered from 0 in the order of the files and of the lines in each."""
    # Splits of a file are told apart by the offset of their block; row ids increase within each.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.filter(F.col("value").rlike(SOMETHING))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("n").over(W.orderBy("file", "block")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    ranked = lines.withColumn("r", within).join(before, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return ranked.select((F.col("before") + F.col("r")).cast("long").alias("id"), "value")


def numbers(value: Column) -> Column:
    """The numbers of a line between any of the delimiters."""
    trimmed = F.regexp_replace(F.regexp_replace(value, DELIMITERS, " "), "^ | $", "")
    return F.transform(F.split(trimmed, " "), lambda x: x.cast("double"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Points from a text file, one vector a line, parsed once into a table of their own; ragged files are rejected."""
    out = keep(numbered_lines(spark, path).select("id", numbers(F.col("value")).alias("features")))
    low, high = out.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low != high:
        raise ValueError(f"{path}: rows have between {low} and {high} numbers")
    return out


def labels(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """<id, label>: an integer a line; carriage returns and blanks around it don't matter."""
    return numbered_lines(spark, path).select("id", F.regexp_replace("value", r"\s", "").cast("long").alias(name))


def decision_graph(spark: SparkSession, path: str) -> DataFrame:
    """<id, rho, delta, dep> from lines ``rho delta dep``. No dependent point is written as an id that isn't there, or as a distance of -1 or above 1e100."""
    rows = numbered_lines(spark, path).select("id", numbers(F.col("value")).alias("x"))
    rho, delta, dep = (F.get("x", F.lit(i)) for i in range(3))
    none = (delta < 0) | (delta > 1e100) | delta.isNull() | dep.isNull()
    return rows.select("id", rho.alias("rho"), F.when(~none, delta).alias("delta"), F.when(~none, dep.cast("long")).alias("dep"))


def label_first(frame: DataFrame, column: str = "value") -> DataFrame:
    """<label, features> of comma-separated rows that begin with the label."""
    parts = F.split(column, ",")
    return frame.select(F.element_at(parts, 1).alias("label"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.try_cast("double")).alias("features"))


RESULTS = """dataset string, method string, comparison string, num_threads long, `Built index time` double, `Compute dependent points time` double,
`Find knn time` double, `Compute density time` double, `Find clusters time` double, `Total time` double,
recall50 double, precision50 double, ARI double, completeness double, homogeneity double"""


def results(spark: SparkSession, *globs: str, schema: str | None = None) -> DataFrame:
    """The union of result files; columns missing in some are null."""
    out = None
    for g in globs:
        part = spark.read.csv(g, header=True, schema=schema, inferSchema=schema is None)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path given")
    return out


def key_values(frame: DataFrame, column: str = "value") -> DataFrame:
    """<key, text, kind, as_long, as_double, as_boolean> of lines key=value, typed as the first of integer, float, boolean, string that fits."""
    key, text = F.trim(F.substring_index(column, "=", 1)), F.trim(F.expr(f"substring({column}, locate('=', {column}) + 1)"))
    pairs = frame.filter(F.col(column).contains("=")).select(key.alias("key"), text.alias("text"))
    whole = F.when(F.col("text").rlike(r"^[+-]?[0-9]+$"), F.col("text").try_cast("long"))
    number = F.when(F.col("text").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("text").try_cast("double"))
    truth = F.when(F.lower("text") == "true", True).when(F.lower("text") == "false", False)
    kind = F.when(whole.isNotNull(), "int").when(number.isNotNull(), "float").when(truth.isNotNull(), "bool").otherwise("str")
    return pairs.select("key", "text", kind.alias("kind"), whole.alias("as_long"), number.alias("as_double"), truth.alias("as_boolean"))
