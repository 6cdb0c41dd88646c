"""Quality classifier by a sparse rule ensemble (operator 9).

Statistics of a text are Spark columns. At most about ``sample`` labelled rows (by a hash of doc_id, ``crc32(doc_id as text) mod 5 <> 0``) reach the
driver as a dozen numbers each; that bound is a parameter. There small trees are grown on random parts of the sample; every path from a root to a
node is a conjunctive rule; a lasso logistic regression keeps at most ``most_rules`` of them; and rules and weights
are compiled into one Spark column expression, so scoring all texts is a projection without shuffle or Python.

Defined results: a null or empty text has all statistics 0 and a score like any other; repeated rows repeat; labels that are null or for unknown
documents are ignored, of contradicting labels of a document the smaller counts, of several texts of a labelled doc_id that with the smallest hash; without labels of both classes every score is the share of label 1
(1 without any labels); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import WORD, crc_mod, text_or_empty

STATISTICS = ("words", "word_length", "upper", "digits", "marks", "odd_marks", "pipes", "stops", "line_words", "line_repeats", "capitals", "word_repeats")
CUTOFF = 0.3


def statistics(text: Column) -> Column:
    """The statistics of a text, as an array in the order of STATISTICS."""
    letters = F.length(text).cast("double")
    base = F.struct(
        text.alias("t"), letters.alias("n"), F.regexp_count(text, F.lit(WORD)).cast("double").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0).alias("l"),
    )

    def count(x: Column, pattern: str) -> Column:
        return F.regexp_count(x["t"], F.lit(pattern)).cast("double")

    def measured(x: Column) -> Column:
        n, w, lines = F.greatest(x["n"], F.lit(1.0)), F.greatest(x["w"], F.lit(1.0)), F.greatest(F.size(x["l"]), F.lit(1)).cast("double")
        return F.array(
            F.log1p(x["w"]), x["n"] / w, count(x, r"\p{Lu}+") / w, count(x, r"[0-9]") / n, count(x, r"[^\p{L}\p{N}\s]") / n, count(x, r"[#$%&*@~^_=<>{}\[\]\\]+|!!+") / w,
            count(x, r"\|") / w, count(x, r"[.?](?=\s|$)") / w, x["w"] / lines, 1 - F.size(F.array_distinct(x["l"])) / lines, count(x, r"\p{Lu}\p{Lu}+") / w,
            count(x, r"(?<!\S)(\S++)\s\1(?!\S)") / w,
        )

    return F.transform(F.array(base), measured)[0]


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng: np.random.Generator, found: set) -> None:
    """Splits rows by the best cut in impurity among random statistics; each path down is a rule."""
    if depth == 0 or len(rows) < 40 or y[rows].min() == y[rows].max():
        return
    best = (0.0, -1, 0.0)
    own = y[rows]
    for j in rng.choice(x.shape[1], size=max(3, x.shape[1] // 2), replace=False):
        values = x[rows, j]
        for cut in np.unique(np.round(np.quantile(values, np.linspace(0.04, 0.96, 24)), 6)):
            left = values <= cut
            k = int(left.sum())
            if 20 <= k <= len(rows) - 20:
                p, q = own[left].mean(), own[~left].mean()
                gain = own.var() - (k * p * (1 - p) + (len(rows) - k) * q * (1 - q)) / len(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, int(j), float(cut))
    gain, j, cut = best
    if j < 0:
        return
    for above in (False, True):
        down = (*path, (j, above, cut))
        found.add(down)
        _grow(x, y, rows[(x[rows, j] > cut) == above], depth - 1, down, rng, found)


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic weights with an L1 penalty (none on the first column), by accelerated proximal gradient steps."""
    n = len(y)
    v = np.ones(r.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-30
    step = 4 * n / (float(v @ (r.T @ (r @ v))) * 1.05 + 1e-9)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(r @ z, -30, 30)))
        moved = z - step * (r.T @ (p - y)) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * strength, 0)
        new[0] = moved[0]
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, most_rules: int = 40, seed: int = 9) -> tuple[float, list[tuple[float, tuple]]]:
    """Bias and weighted rules for P(label 1)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return float(np.log(share / (1 - share))), []
    rng = np.random.default_rng(seed)
    found: set = set()
    for _ in range(trees):
        rows = rng.choice(len(y), size=min(len(y), 4_000), replace=True)
        _grow(x, y.astype(np.float64), rows, depth, (), rng, found)
    rules = sorted(found)
    held = rng.random(len(y)) < 0.25
    r = np.column_stack([np.ones(len(y)), *[_holds(rule, x) for rule in rules]]).astype(np.float64)
    best, w, chosen = np.inf, np.zeros(r.shape[1]), np.zeros(r.shape[1])
    for strength in np.geomspace(0.05, 0.0004, 8):  # from sparse to dense, until held-back rows fit worse or there are too many rules
        w = _lasso(r[~held], y[~held], strength, w)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[held] @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)) if held.any() else 0.0
        if (w[1:] != 0).sum() > most_rules:
            break
        if loss < best:
            best, chosen = loss, w.copy()
    return float(chosen[0]), [(float(c), rule) for c, rule in zip(chosen[1:], rules, strict=True) if c]


def compiled(model: tuple[float, list[tuple[float, tuple]]], stats: Column) -> Column:
    """The ensemble as a column expression over the array of statistics."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        holds = F.lit(True)
        for j, above, cut in rule:
            holds = holds & ((stats[j] > cut) if above else (stats[j] <= cut))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> tuple[float, list[tuple[float, tuple]]]:
    """The ensemble learned from a bounded sample of the labelled rows of docs."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    known = known.groupBy(F.col("doc_id").alias("l_doc")).agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    unit = F.pmod(F.xxhash64(F.col("l_doc"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = F.broadcast(known.filter(unit < share))  # about ``sample`` rows of two numbers
    docs = docs.select("doc_id", "text")
    rows = docs.join(some, docs["doc_id"] == F.col("l_doc")).select("doc_id", F.struct(statistics(text_or_empty(docs)).alias("stats"), "quality").alias("row"), F.xxhash64(text_or_empty(docs)).alias("mark"))
    rows = rows.groupBy("doc_id").agg(F.min_by("row", "mark").alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    x = np.array(rows["stats"].tolist(), dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, rows["quality"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = train(docs, labels, sample)
    base = docs.select("doc_id", statistics(text_or_empty(docs)).alias("stats"))
    return base.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), compiled(model, F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    model = train(docs, labels, sample)
    columns = docs.columns
    measured = docs.select(F.struct(*[docs[c] for c in columns]).alias("__row"), statistics(text_or_empty(docs)).alias("__stats"))
    return measured.filter(compiled(model, F.col("__stats")) >= CUTOFF).select("__row.*")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
