"""URL filter by the likelihood ratio of two character language models (operator 7), DataFrame functions only.

Rules on host and path decide first; the longest that fits wins. The URLs they allow and block are also what the models learn from: variable-order
Markov models over folded host and path (lower case, digits as 0, rare characters as ~), Witten-Bell smoothed from order ``ORDER`` down to
uniform, where a context is used only if seen at least ``LEAST`` times. A URL's score is the mean over its characters of log p(accepted) - log p(rejected);
the cut is the score with the best balanced accuracy on held-back shapes of ruled URLs.

URLs fold to few shapes, so counting and scoring run over distinct shapes. The table of n-grams has at most ``len(SYMBOLS) ** (ORDER + 1)`` rows
whatever the input; it is broadcast only below ``BROADCAST_ROWS``.

Defined results: a null URL, or one without ``://``, has empty host and path and scores 0; without both kinds of ruled URLs every score counts from a
cut at 0; repeated rows repeat; an empty table gives no rows; columns besides page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.session import Scratch

#: The rules, as host and path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./_-~^$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
LEAST = 4
SCALE = 1_000_000  # log ratios are added up as integers: sums don't depend on order
BINS = 100
BROADCAST_ROWS = 200_000
HELD_BACK = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _shape(host: Column, path: Column) -> Column:
    folded = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(folded, r"(?s)[^a-z0./_-]", "~")


def _grams(shapes: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of each shape, with the ORDER characters before it."""
    padded = F.concat(F.lit("^" * ORDER), F.col("shape"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("shape") + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))
    return shapes.select(*keep, F.explode(grams).alias("gram"))


def _log_ratios(learned: DataFrame, events: DataFrame, run: Scratch) -> DataFrame:
    """gram and ratio (scaled log p(accepted) - log p(rejected)) of each event. learned: gram, a, b (accepted and rejected counts)."""
    seen = run.put(learned.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")
    out = events.select("gram", F.lit(1 / len(SYMBOLS)).alias("pa"), F.lit(1 / len(SYMBOLS)).alias("pb"))
    for k in range(ORDER + 1):
        cut = F.substr("gram", F.lit(ORDER + 1 - k), F.lit(k + 1))
        counts = seen.groupBy(cut.alias("k_gram")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        contexts = counts.groupBy(F.substr("k_gram", F.lit(1), F.lit(k)).alias("k_context")).agg(
            *[F.sum(f"n{x}").alias(f"s{x}") for x in "ab"], *[F.count(F.when(F.col(f"n{x}") > 0, 1)).alias(f"t{x}") for x in "ab"]
        )
        # cut refers to gram, which both sides of the first join have under other names
        out = out.withColumn("cut", cut).join(counts, F.col("cut") == F.col("k_gram"), "left").drop("k_gram")
        out = out.withColumn("context", F.substr("cut", F.lit(1), F.lit(k))).join(contexts, F.col("context") == F.col("k_context"), "left").drop("k_context")

        def smoothed(x: str) -> Column:
            n, s, t = (F.coalesce(F.col(f"{c}{x}"), F.lit(0)) for c in "nst")
            known = s >= (LEAST if k else 1)
            return F.when(known, (n + t * F.col(f"p{x}")) / (s + t)).otherwise(F.col(f"p{x}"))

        out = out.select("gram", smoothed("a").alias("pa"), smoothed("b").alias("pb"))
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) * SCALE).cast("long").alias("ratio"))


def _cut(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy: of ties the one nearest to 0."""
    bins = F.floor(F.greatest(F.least(F.col("score"), F.lit(20.0)), F.lit(-20.0)) * BINS).cast("int").alias("bin")
    rows = scored.groupBy("held", bins).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # at most 2 x 4001 rows
    for held in (True, False):
        some = sorted((r["bin"], r["a"], r["b"]) for r in rows if r["held"] == held)
        all_a, all_b = sum(r[1] for r in some), sum(r[2] for r in some)
        if all_a and all_b:
            break
    else:
        return 0.0
    best, below_a, below_b = [], 0, 0
    for at, a, b in [*some, (some[-1][0] + 1, 0, 0)]:  # URLs at or above the cut are accepted
        best.append((-(all_a - below_a) / all_a - below_b / all_b, abs(at), at))
        below_a, below_b = below_a + a, below_b + b
    return min(best)[2] / BINS


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages."""
    host, path = host_and_path(pages["url"])
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    with Scratch() as run:
        base = run.put(base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _shape(F.col("host"), F.col("path")).alias("shape")), "urls")
        shapes = base.groupBy("shape").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
        held = F.conv(F.substring(F.md5(F.col("shape").cast("binary")), 1, 7), 16, 10).cast("long") % HELD_BACK == 0
        shapes = run.put(shapes.withColumn("held", held), "shapes")
        model = run.put(_log_ratios(_grams(shapes.filter("NOT held AND a + b > 0"), "a", "b"), _grams(shapes).distinct(), run), "ratios")
        model = F.broadcast(model) if model.count() <= BROADCAST_ROWS else model
        mean = (F.sum("ratio") / F.count("*") / SCALE).alias("score")
        scored = _grams(shapes.filter("shape <> ''"), "shape").join(model, "gram").groupBy("shape").agg(mean)
        scored = run.put(scored.join(shapes, "shape").select("shape", "score", "a", "b", "held"), "scores")
        cut = _cut(scored.filter("a + b > 0"))
        marks = scored.select(F.col("shape").alias("s_shape"), "score")
        out = base.join(marks, F.col("shape") == F.col("s_shape"), "left")
        score = F.coalesce("score", F.lit(0.0))
        out = out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score >= cut, "allow").otherwise("block")).alias("verdict"), score.alias("score"))
        return run.leave(out, base, scored)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same models and cut in SQL."""
    fits = [(rule, *rule.partition("/")[::2]) for rule, _ in sorted(RULES, key=lambda r: -len(r[0]))]
    rule = " ".join(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}') THEN '{text}'" for text, at, rest in fits)
    says = " ".join(f"WHEN '{text}' THEN '{verdict}'" for text, verdict in RULES)
    levels = ""
    for k in range(ORDER + 1):
        before, part, context = f"p{k - 1}" if k else "e", f"substr(p.gram, {ORDER + 1 - k}, {k + 1})", f"substr(p.gram, {ORDER + 1 - k}, {k})"
        side = lambda x: f"CASE WHEN coalesce(s{x}, 0) >= {LEAST if k else 1} THEN (coalesce(n{x}, 0) + t{x} * p{x}) / (s{x} + t{x}) ELSE p{x} END AS p{x}"  # noqa: B023, E731
        levels += f""", c{k} AS (
  SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS kg, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM l GROUP BY 1
), x{k} AS (
  SELECT substr(kg, 1, {k}) AS kc, sum(na) AS sa, sum(nb) AS sb, count(*) FILTER (na > 0)::DOUBLE AS ta, count(*) FILTER (nb > 0)::DOUBLE AS tb FROM c{k} GROUP BY 1
), p{k} AS (
  SELECT p.gram, {side('a')}, {side('b')} FROM {before} p LEFT JOIN c{k} ON c{k}.kg = {part} LEFT JOIN x{k} ON x{k}.kc = {context}
)"""
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r AS (
  SELECT *, CASE {rule} END AS rule, regexp_replace(translate(host || path, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./_-]', '~', 'g') AS shape FROM u
), v AS (
  SELECT *, CASE rule {says} END AS ruled FROM r
), s AS (
  SELECT shape, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b, ('0x' || substr(md5(shape), 1, 7))::BIGINT % {HELD_BACK} = 0 AS held FROM v GROUP BY shape
), g AS (
  SELECT shape, a, b, held, unnest(list_transform(range(1, len(shape) + 2), lambda i: substr('{"^" * ORDER}' || shape || '$', i, {ORDER + 1}))) AS gram FROM s
), l AS (
  SELECT gram, sum(a) AS a, sum(b) AS b FROM g WHERE NOT held AND a + b > 0 GROUP BY gram
), e AS (
  SELECT DISTINCT gram, 1 / {len(SYMBOLS)}::DOUBLE AS pa, 1 / {len(SYMBOLS)}::DOUBLE AS pb FROM g
){levels}, m AS (
  SELECT gram, round((ln(pa) - ln(pb)) * {SCALE})::BIGINT AS ratio FROM p{ORDER}
), scored AS (
  SELECT shape, any_value(a) AS a, any_value(b) AS b, any_value(held) AS held, sum(ratio)::DOUBLE / count(*) / {SCALE} AS score FROM g JOIN m USING (gram) WHERE shape <> '' GROUP BY shape
), bins AS (
  SELECT held, floor(greatest(least(score, 20.0), -20.0) * {BINS})::INTEGER AS bin, sum(a) AS a, sum(b) AS b FROM scored WHERE a + b > 0 GROUP BY ALL
), side AS (
  SELECT held FROM bins GROUP BY held HAVING sum(a) > 0 AND sum(b) > 0 ORDER BY held DESC LIMIT 1
), steps AS (
  SELECT bin, a, b FROM bins WHERE held = (SELECT held FROM side) UNION ALL SELECT max(bin) + 1, 0, 0 FROM bins WHERE held = (SELECT held FROM side)
), tried AS (
  SELECT bin, (sum(a) OVER () - (sum(a) OVER o - a))::DOUBLE / (sum(a) OVER ())::DOUBLE + (sum(b) OVER o - b)::DOUBLE / (sum(b) OVER ())::DOUBLE AS accuracy FROM steps WINDOW o AS (ORDER BY bin)
), cut AS (
  SELECT coalesce((SELECT bin FROM tried WHERE bin IS NOT NULL ORDER BY accuracy DESC, abs(bin), bin LIMIT 1) / {BINS}, 0) AS cut
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN (SELECT shape, score FROM scored) USING (shape), cut
"""


OP7_SQL = _sql()
