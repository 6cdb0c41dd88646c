"""Secret scans (operator 2), DataFrame functions only.

Base patterns give spans of three kinds. Beside them, runs of 20 or more key characters outside base spans are candidates for the kind ``random``:

* encoding: the smallest alphabet that holds the run (decimal, hex, base32, letters and digits, base64);
* battery, null hypothesis "uniform over that alphabet": chi-squared of the symbol counts (Wilson-Hilferty), number of runs of lower and
  upper half symbols (Wald-Wolfowitz), serial correlation of neighbouring symbols; a candidate fails if a p-value, corrected for three
  tests, is below ``BATTERY``;
* length-aware false-discovery control, null hypothesis "ordinary text": under it the chi-squared statistic grows with length
  by the letters' unevenness, so p is the chance of so small a value at that length, times that of so many characters all lying in the alphabet. Benjamini-Hochberg at ``FDR`` within each class of
  lengths, over all candidates of all documents, by a histogram of p-values (at most 3 x 601 cells reach the driver).

A candidate that passes both is a span. Positions are code points, ends exclusive. Positions come from splitting the text at its matches:
lengths of gaps and matches add up, as running sums over the matches of a row; candidates that meet a base span are found by running ends and
starts over its sorted spans. So the work grows with the number of matches, and only matches are shuffled, never texts. Defined results: a null or empty text has no spans, base_sha256 of the empty text and empty spans; repeated rows
repeat; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.llm.common import text_or_empty
from crestline.session import Scratch

#: The base patterns.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs, so the same as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

LEAST = {"assign": 8}  # code points of a value
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets from small to large, and how often a character of ordinary text or numbers lies in each.
ALPHABETS = (
    (r"^[0-9]+$", "0123456789", 1.0),
    (r"^[0-9a-f]+$", "0123456789abcdef", 0.35),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.35),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1.0),
    (r"^[0-9A-Za-z+/_-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", 1.0),
)
#: The same for scans that also take runs right after ``=`` and know keys over one case of letters with digits (see scan).
WIDE_CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
WIDE_ALPHABETS = (
    *ALPHABETS[:4],
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.0),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.0),
    *ALPHABETS[4:],
)
BATTERY = 0.001
FDR = 0.01
TEXT_REPEAT = 0.065  # chance that two letters of ordinary text are equal
LENGTH_CLASSES = (32, 64)
P_STEPS, P_CELLS = 40, 600  # cells of 1/40 of a power of ten


def _hits(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Matches of pattern in order, as structs of kind number, place among them, code points since the match before (or the beginning), own code points and value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    none = F.array().cast("array<struct<kind:int,i:int,gap:long,n:long,value:string>>")

    def one(m: Column, i: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(m["g"]).cast("long").alias("gap"), F.length(m["h"]).cast("long").alias("n"), m["v"].alias("value"))

    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h"), values.alias("v")), one)).otherwise(none)


def _placed(hits: DataFrame) -> DataFrame:
    """__row, doc_id, kind, start, end and value of the matches that count; rows all of whose matches fall away keep one without a kind. hits: <__row, doc_id, hits>."""
    m = hits.select("__row", "doc_id", F.explode("hits").alias("m")).select("__row", "doc_id", "m.*").repartition("__row")
    upto = W.partitionBy("__row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    least = F.coalesce(*[F.when(F.col("kind") == KINDS.index(k), F.lit(n)) for k, n in LEAST.items()], F.lit(0))
    base = (F.col("kind") < 3) & (F.length("value") >= least)
    # Base spans that begin at or before a candidate, then those that begin at or behind it.
    before = W.partitionBy("__row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("__row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("ended", F.max(F.when(base, F.col("end"))).over(before)).withColumn("begun", F.min(F.when(base, F.col("start"))).over(behind))
    met = (F.coalesce("ended", F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("begun") < F.col("end"), F.lit(False)))
    return m.select("__row", "doc_id", F.when(base | (F.col("kind") == 3) & ~met, F.col("kind")).alias("kind"), "start", "end", "value")


def _upper_normal(z: Column) -> Column:
    """P(Z > z), by the logistic approximation, which is off by less than 0.0002; floored so that its logarithm is bounded."""
    bounded = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return F.greatest(1 / (1 + F.exp(1.5976 * bounded + 0.07056 * F.pow(bounded, F.lit(3.0)))), F.lit(1e-15))


def _judged(value: Column, alphabets: tuple = ALPHABETS) -> Column:
    """The battery's smallest p-value (corrected for three tests) and the p-value under the null hypothesis "ordinary text"."""
    body = F.translate(F.rtrim(F.translate(value, "=", " ")), "-_", "+/")
    alphabet, size, cover = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(1.0)
    for pattern, letters, often in reversed(alphabets):
        fits = body.rlike(pattern)
        cover = F.when(fits, F.lit(often)).otherwise(cover)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        size = F.when(fits, F.lit(float(len(letters)))).otherwise(size)
    # One struct after another, so that each step is computed once for a candidate.
    first = F.struct(body.alias("b"), F.length(body).cast("double").alias("n"), alphabet.alias("a"), size.alias("k"), cover.alias("f"), F.split(body, "").alias("c"))

    def tests(x: Column) -> Column:
        n, k = x["n"], x["k"]
        squares = F.aggregate(F.array_distinct(x["c"]), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(x["b"], c, F.lit(""))), F.lit(2.0)))
        places = F.transform(x["c"], lambda c: F.instr(x["a"], c).cast("double"))
        return F.struct(n.alias("n"), k.alias("k"), x["f"].alias("f"), (k / n * squares - n).alias("x2"), places.alias("v"))

    def more(x: Column) -> Column:
        n, v = x["n"], x["v"]
        half = F.transform(v, lambda p: (p > x["k"] / 2).cast("double"))
        ones = F.aggregate(half, F.lit(0.0), lambda s, b: s + b)
        pairs = F.zip_with(F.slice(half, 1, F.size(half) - 1), F.slice(half, 2, F.size(half) - 1), lambda a, b: F.abs(a - b))
        mean = F.aggregate(v, F.lit(0.0), lambda s, p: s + p) / n
        spread = F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p) / n - mean * mean
        products = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - mean) * (b - mean))
        return F.struct(
            n.alias("n"), x["k"].alias("k"), x["f"].alias("f"), x["x2"].alias("x2"), ones.alias("ones"), (1 + F.aggregate(pairs, F.lit(0.0), lambda s, b: s + b)).alias("runs"),
            F.when(spread > 0, F.aggregate(products, F.lit(0.0), lambda s, p: s + p) / (n * F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(1.0)).alias("serial"),
        )

    def p_values(x: Column) -> Column:
        n, df = x["n"], x["k"] - 1
        cube = F.pow(F.greatest(x["x2"], F.lit(0.0)) / df, F.lit(1 / 3))
        chi = _upper_normal((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        product = 2 * x["ones"] * (n - x["ones"])
        variance = product * (product - n) / (n * n * (n - 1))
        runs = F.when(variance > 0, 2 * _upper_normal(F.abs(x["runs"] - product / n - 1) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(1e-15))
        serial = 2 * _upper_normal(F.abs(x["serial"] + 1 / n) * F.sqrt(n))
        # Under ordinary text: mean df + n * uneven, variance as of a noncentral chi-squared.
        uneven = F.greatest(x["k"] * TEXT_REPEAT - 1, F.lit(0.25))
        text = _upper_normal((df + n * uneven - x["x2"]) / F.sqrt(2 * df + 4 * n * uneven))
        text = F.greatest(text * F.pow(x["f"], n), F.lit(1e-15))  # and the whole run lies in the alphabet
        return F.struct(F.least(chi, runs, serial, F.lit(1 / 3)).alias("low"), text.alias("text"), n.alias("n"))

    step = F.transform(F.array(first), tests)
    step = F.transform(step, more)
    got = F.transform(step, p_values)[0]
    return F.struct((got["low"] * 3).alias("battery"), got["text"].alias("text"), got["n"].cast("long").alias("n"))


def _class(n: Column) -> Column:
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTH_CLASSES), F.lit(0))


def _cell(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * P_STEPS), F.lit(P_CELLS)).cast("int")


def _cuts(found: DataFrame, fdr: float) -> dict[int, int]:
    """By class of lengths, the first cell of p-values that counts as a discovery."""
    cells = found.filter("kind = 3").groupBy(_class(F.col("p.n")).alias("class"), _cell(F.col("p.text")).alias("cell")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("p.battery") >= BATTERY, 1).otherwise(0)).alias("passed"))
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for r in cells.collect():  # at most 3 x 601 rows
        by[r["class"]].append((r["cell"], r["n"], r["passed"]))
    cuts = {}
    for k, rows in by.items():
        total, taken, cut = sum(n for _, n, _ in rows), 0, P_CELLS + 1
        for cell, _, passed in sorted(rows, reverse=True):
            taken += passed
            if taken and total * 10 ** (-cell / P_STEPS) / taken <= fdr:
                cut = cell
        cuts[k] = cut
    return cuts


def scan(docs: DataFrame, fdr: float = FDR, candidate: str = CANDIDATE, alphabets: tuple = ALPHABETS) -> DataFrame:
    """doc_id and its spans, each with start, end, kind (0 assign, 1 access, 2 hex, 3 random) and value (assign: group 2), in order. With WIDE_CANDIDATE runs that
    follow ``=`` directly are candidates too; with WIDE_ALPHABETS keys over small or capital letters with digits are tested over their own alphabet."""
    text = text_or_empty(docs)
    each = [_hits(text, "assign", ASSIGN, 1), _hits(text, "access", ACCESS), _hits(text, "hex", HEX), _hits(text, "random", candidate)]
    with Scratch() as run:
        hits = run.put(docs.select(F.monotonically_increasing_id().alias("__row"), docs["doc_id"], F.concat(*each).alias("hits")), "hits")
        found = _placed(hits.filter(F.size("hits") > 0))
        found = run.put(found.withColumn("p", F.when(F.col("kind") == 3, _judged(F.col("value"), alphabets))), "spans")
        first = F.lit(P_CELLS + 1)
        for k, cut in _cuts(found, fdr).items():
            first = F.when(_class(F.col("p.n")) == k, F.lit(cut)).otherwise(first)
        flagged = (F.col("kind") < 3) | (F.col("p.battery") >= BATTERY) & (_cell(F.col("p.text")) >= first)
        span = F.when(flagged, F.struct("start", "kind", "end", "value"))
        spans = found.groupBy("__row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # no longer than the row's text
        none = hits.filter(F.size("hits") == 0).select("doc_id", F.array().cast(dict(spans.dtypes)["spans"]).alias("spans"))
        out = spans.select("doc_id", "spans").unionByName(none)
        return run.leave(out.select("doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans"), hits, found)


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def _sql() -> str:
    """The same spans, battery and cuts in SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def spans(name: str, pattern: str, group: int) -> str:
        p = quoted(pattern)
        return f"""{name} AS (
  SELECT rid, hits[i] AS hit, vals[i] AS val,
    (list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0))::BIGINT AS beg
  FROM (SELECT rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i
    FROM (SELECT rid, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d))
)"""

    bare = "(?:^|[^A-Za-z0-9+/_=-])(" + CANDIDATE.partition(")")[2] + ")"  # no look-behind here: the character before is matched and then left out
    pick = lambda i: " ".join(f"WHEN regexp_matches(body, {quoted(a[0])}) THEN {quoted(a[i]) if i == 1 else len(a[1]) if i == 3 else a[2]}" for a in ALPHABETS)
    upper = lambda z: f"greatest(1 / (1 + exp(1.5976 * greatest(least({z}, 8.0), -8.0) + 0.07056 * pow(greatest(least({z}, 8.0), -8.0), 3))), 1e-15)"
    total = lambda items: f"list_sum({items})"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), {spans('assigned', ASSIGN, 1)}, {spans('accessed', ACCESS, 0)}, {spans('hexed', HEX, 0)}, {spans('ran', bare, 1)},
base AS (
  SELECT rid, beg AS s, 0 AS kind, beg + len(hit) AS e FROM assigned WHERE len(val) >= 8
  UNION ALL SELECT rid, beg, 1, beg + len(hit) FROM accessed UNION ALL SELECT rid, beg, 2, beg + len(hit) FROM hexed
), cand AS (
  SELECT rid, beg + len(hit) - len(val) AS s, beg + len(hit) AS e, translate(rtrim(val, '='), '-_', '+/') AS body FROM ran
), alone AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s < c.e AND c.s < b.e)
), one AS (
  SELECT *, len(body)::DOUBLE AS n, CASE {pick(1)} END AS letters, (CASE {pick(3)} END)::DOUBLE AS k, (CASE {pick(2)} END)::DOUBLE AS f, string_split(body, '') AS chars FROM alone
), two AS (
  SELECT *, k / n * {total("list_transform(list_distinct(chars), lambda c: pow(n - len(replace(body, c, '')), 2))")} - n AS x2, list_transform(chars, lambda c: instr(letters, c)::DOUBLE) AS v FROM one
), three AS (
  SELECT *, list_transform(v, lambda p: CASE WHEN p > k / 2 THEN 1 ELSE 0 END) AS h, {total("v")} / n AS mean, {total("list_transform(v, lambda p: p * p)")} / n - pow({total("v")} / n, 2) AS spread FROM two
), four AS (
  SELECT *, {total("h")}::DOUBLE AS ones, 1 + {total("list_transform(range(1, len(h)), lambda i: abs(h[i] - h[i + 1]))")} AS runs,
    CASE WHEN spread > 0 THEN {total("list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))")} / (n * greatest(spread, 1e-9)) ELSE 1 END AS serial FROM three
), five AS (
  SELECT *, k - 1 AS df, 2 * ones * (n - ones) AS product FROM four
), six AS (
  SELECT *, product * (product - n) / (n * n * (n - 1)) AS variance, greatest(k * {TEXT_REPEAT} - 1, 0.25) AS uneven FROM five
), seven AS (
  SELECT *, {upper("(pow(greatest(x2, 0) / df, 1 / 3.0::DOUBLE) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))")} AS p1,
    CASE WHEN variance > 0 THEN 2 * {upper("abs(runs - product / n - 1) / sqrt(greatest(variance, 1e-9))")} ELSE 1e-15 END AS p2,
    2 * {upper("abs(serial + 1 / n) * sqrt(n)")} AS p3,
    greatest({upper("(df + n * uneven - x2) / sqrt(2 * df + 4 * n * uneven)")} * pow(f, n), 1e-15) AS p4 FROM six
), eight AS (
  SELECT rid, s, e, least(p1, p2, p3, 1 / 3.0::DOUBLE) * 3 >= {BATTERY} AS passed, {" + ".join(f"(n >= {least})::INTEGER" for least in LENGTH_CLASSES)} AS class, least(floor(-log10(p4) * {P_STEPS}), {P_CELLS})::INTEGER AS cell FROM seven
), cells AS (
  SELECT class, cell, count(*) AS n, count(*) FILTER (passed) AS ok FROM eight GROUP BY ALL
), sums AS (
  SELECT class, cell, sum(n) OVER (PARTITION BY class) AS total, sum(ok) OVER (PARTITION BY class ORDER BY cell DESC) AS taken FROM cells
), cuts AS (
  SELECT class, min(cell) AS cut FROM sums WHERE taken > 0 AND total * pow(10, -cell / {P_STEPS}.0::DOUBLE) / taken <= {FDR} GROUP BY class
), spans AS (
  SELECT rid, s, kind, e FROM base UNION ALL SELECT rid, s, 3, e FROM eight JOIN cuts USING (class) WHERE passed AND cell >= cut
), written AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg((['assign', 'access', 'hex', 'random'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
    string_agg((['assign', 'access', 'hex', 'random'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN written USING (rid)
"""


OP2_SQL = _sql()
