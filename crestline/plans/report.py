"""Analysis of result tables and decision graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


RANGES = 64  # of the x axis of a front


def pareto(df: DataFrame, x: str, y: str, smallest_x: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row for each point on the front of small (or large) x and large y: in order of x, those with a y above all before. Rows without a number as x or y
    are on no front. The largest y of each x is all that counts; the axis is cut into ranges, whose largest y add up to what lies before a range."""
    by = by or []
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    tops = known.groupBy(*by, F.col(x).alias("__x")).agg(F.max(y).alias("__y"))
    place = F.col("__x").cast("double") * (1 if smallest_x else -1)
    cuts = tops.agg(F.percentile_approx(place, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []  # RANGES numbers
    tops = tops.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= place)) if cuts else F.lit(0))
    ends = tops.groupBy(*by, "__range").agg(F.max("__y").alias("__top"))  # at most RANGES rows for each group
    ends = ends.withColumn("__before", F.max("__top").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).drop("__top")
    within = W.partitionBy(*by, "__range").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    met = tops.withColumn("__inner", F.max("__y").over(within)).join(ends, [*by, "__range"])
    before = F.greatest("__inner", "__before")  # nulls are passed over
    front = met.filter(before.isNull() | (F.col("__y") > before)).select(*by, F.col("__x").alias(x), F.col("__y").alias(y))
    rest = [c for c in df.columns if c not in (*by, x, y)]
    if not rest:
        return front.select(*df.columns)
    return known.join(front, [*by, x, y]).groupBy(*by, x, y).agg(F.first(F.struct(*rest)).alias("__rest")).select(*[F.col("__rest")[c].alias(c) if c in rest else c for c in df.columns])


def best_within(front: DataFrame, x: str, y: str, tolerance: float = 0.003, by: list[str] | None = None) -> DataFrame:
    """The first row of a front whose y is within tolerance of the last one."""
    by = by or []
    best = front.groupBy(*by).agg(F.max(y).alias("__best"))
    near = (front.join(best, by) if by else front.join(F.broadcast(best))).filter(F.abs(F.col(y) - F.col("__best")) < tolerance)  # without groups best is one row
    first = near.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in front.columns]), x).alias("__row"))
    return first.filter("__row IS NOT NULL").select("__row.*")


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def decode_method(df: DataFrame, column: str = "method") -> DataFrame:
    """Parts of a method name graph_maxdegree_alpha_Lbuild_L_Lnn_density_K as columns; density and K are the last two."""
    part = F.split(column, "_")
    numbers = {"max_degree": "long", "alpha": "double", "Lbuild": "long", "L": "long", "Lnn": "long"}
    out = df.withColumn("graph", F.get(part, F.lit(0)))
    for i, (name, kind) in enumerate(numbers.items(), 1):
        out = out.withColumn(name, F.when(F.size(part) >= 8, F.get(part, F.lit(i))).try_cast(kind))
    return out.withColumn("density", F.get(part, F.size(part) - 2)).withColumn("K", F.get(part, F.size(part) - 1).try_cast("long"))


def time_shares(df: DataFrame, stages: dict[str, Column], total: Column) -> DataFrame:
    """Each stage's share of the total in percent."""
    return df.withColumns({name: F.when(total != 0, stage / total * 100) for name, stage in stages.items()})


def speedup(df: DataFrame, group: str, threads: str, seconds: str) -> DataFrame:
    """df with the time of the group's first row by threads over its own time."""
    return df.withColumn("speedup", F.first(seconds).over(W.partitionBy(group).orderBy(threads)) / F.col(seconds))


def loglog_slope(df: DataFrame, size: str, seconds: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of ln(seconds) on ln(size)."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(F.log(seconds), F.log(size)).alias("slope"))


def linear_regression(df: DataFrame, features: list[str], target: str, degree: int = 1):
    """Fitted coefficients, r2 and mean absolute error on complete rows; degree above 1 adds polynomial features."""
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(complete_rows(df, [*features, target]))
    if degree > 1:
        rows = PolynomialExpansion(degree=degree, inputCol="__x", outputCol="__p").transform(rows).drop("__x").withColumnRenamed("__p", "__x")
    fitted = LinearRegression(featuresCol="__x", labelCol=target, solver="normal").fit(rows)
    return {"coefficients": list(fitted.coefficients), "intercept": fitted.intercept, "r2": fitted.summary.r2, "mae": fitted.summary.meanAbsoluteError}


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.na.drop(subset=columns)


def cluster_ratio(df: DataFrame, truth: DataFrame, key: str = "dataset") -> DataFrame:
    """num_clusters over the true number, truth: <key, gt_num_clusters>."""
    return df.join(truth, key).withColumn("ratio", F.col("num_clusters") / F.col("gt_num_clusters"))


def without_zero_metrics(df: DataFrame) -> DataFrame:
    return df.filter((F.col("homogeneity") != 0) & (F.col("completeness") != 0))


def largest_clusters(found: DataFrame, most: int = 20) -> DataFrame:
    """<cluster, n> of the largest clusters."""
    return found.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(most)


def singletons(found: DataFrame) -> DataFrame:
    """<id, cluster> of points that are alone in their cluster. Sizes are aggregated first, so no cluster has to fit a task."""
    alone = found.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n <= 1")
    return alone.select("id", "cluster")


def _finite(graph: DataFrame) -> DataFrame:
    """delta of every point; missing or above 1e11 as the largest finite one."""
    top = graph.filter(F.col("delta") <= 1e11).agg(F.max("delta").alias("__top"))
    return graph.join(F.broadcast(top)).withColumn("delta", F.when(F.col("delta") <= 1e11, F.col("delta")).otherwise(F.col("__top"))).drop("__top")


def threshold_for(graph: DataFrame, clusters: int) -> DataFrame:
    """One row: the middle between the c-th and the next largest delta."""
    top = _finite(graph).select("delta").orderBy(F.desc("delta")).limit(clusters + 1)
    return top.select("delta", F.row_number().over(W.orderBy(F.desc("delta"))).alias("r")).filter(F.col("r") >= clusters).agg(F.avg("delta").alias("threshold"))


def top_by_product(graph: DataFrame, most: int = 10) -> DataFrame:
    return _finite(graph).withColumn("product", F.col("rho") * F.col("delta")).orderBy(F.desc("product"), "id").limit(most)


def top_by_delta(graph: DataFrame, most: int) -> DataFrame:
    return _finite(graph).orderBy(F.desc("delta"), "id").limit(most)


def value_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """<bin, n> of equal bins between the smallest and the largest value; the last bin includes the largest."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(F.col("__hi") == F.col("__lo"), F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("__lo")) / width) + 1, F.lit(bins)))
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).select(place.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def encode(df: DataFrame, column: str, by_first_appearance: str | None = None) -> DataFrame:
    """df with ``code``: labels numbered from 0 in sorted order, or in the order in which they first appear by another column."""
    values = df.groupBy(column).agg(F.min(by_first_appearance).alias("__first")) if by_first_appearance else df.select(column).distinct()
    order = W.orderBy("__first", column) if by_first_appearance else W.orderBy(column)  # rows are distinct labels
    codes = values.select(F.col(column).alias("__label"), (F.dense_rank().over(order) - 1).cast("long").alias("code"))
    return df.join(codes, df[column].eqNullSafe(F.col("__label"))).drop("__label")


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def relabelled(df: DataFrame, names: dict[str, str], constants: dict[str, Column]) -> DataFrame:
    """Renamed and added columns, ready for unionByName(allowMissingColumns=True) with other results."""
    return df.withColumnsRenamed(names).withColumns(constants)
