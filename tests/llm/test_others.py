"""Embeddings, URLs and the pipeline against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from crestline import session
from crestline.llm import embeddings, rules, urls
from tests.llm.test_documents import BPE, DOC, edge_rows, plain_mix, plain_quality, repeated_rows, stay_exact, stay_near


def brute_vectors(rows, threshold=0.98):
    ok = lambda r: r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if ok(x) and ok(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        least[find(a)] = min(least.get(find(a), r[0]), r[0])
    return Counter((r[0], links[a], least[find(a)], r[0] == least[find(a)]) for a, r in enumerate(rows))


@pytest.mark.parametrize("block", [1_024, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 32))
    rows = [(i, (base[i % 12] + rng.standard_normal(32) * rng.choice([0, 0.05, 0.12, 0.2])).astype(np.float32).tolist(), int(i % 12 % 3)) for i in range(260)]
    rows += [(300 + i, base[0].astype(np.float32).tolist(), 0) for i in range(40)]
    rows += [(400, None, 0), (401, [0.0] * 32, 0), (402, [float("nan")] * 32, 0), (403, base[0].tolist(), None), (404, [1.0, None], 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1), (408, [float("inf"), 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect())
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert got == brute_vectors(rounded)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    d, miss, errors = 64, 0, []
    for _ in range(40):
        turn = embeddings._rotations(d, d, int(rng.integers(1 << 30)))
        o = rng.standard_normal(d)
        q = o + 0.2 * rng.standard_normal(d)
        o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
        y, z = turn @ o, turn @ q
        code = np.sign(y) / math.sqrt(d)
        f = code @ y
        errors.append(code @ z / f - o @ q)
        miss += abs(code @ z - f * (o @ q)) > 5 * math.sqrt(1 - f * f) * math.sqrt(1 - (o @ q) ** 2) / math.sqrt(d - 1)
    assert miss == 0 and abs(np.mean(errors)) < 3 * np.std(errors) / math.sqrt(len(errors)) + 1e-3


def fold(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    shape = "".join(c if c in "abcdefghijklmnopqrstuvwxyz./_-" else "0" if c in "0123456789" else "~" for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in host + path))
    return host, path, shape


def brute_rule(host, path):
    best = (None, None)
    for text, says in urls.RULES:
        at, _, rest = text.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best[0] is None or len(text) > len(best[0])):
            best = (text, says)
    return best


def brute_scores(shapes, learned):
    """Mean log ratio of each shape, by counts in dictionaries. learned: shape, accepted, rejected."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in "ab"]
    for shape, *weights in learned:
        padded = "^" * urls.ORDER + shape + "$"
        for i in range(urls.ORDER, len(padded)):
            for side, w in enumerate(weights):
                for k in range(urls.ORDER + 1):
                    counts[side][(k, padded[i - k : i])][padded[i]] += w

    def p(side, context, c):
        out = 1 / len(urls.SYMBOLS)
        for k in range(urls.ORDER + 1):
            own = counts[side].get((k, context[len(context) - k :]), {})
            s, t = sum(own.values()), sum(v > 0 for v in own.values())
            if s >= (urls.LEAST if k else 1):
                out = (own.get(c, 0) + t * out) / (s + t)
        return out

    out = {}
    for shape in shapes:
        padded = "^" * urls.ORDER + shape + "$"
        logs = [math.log(p(0, padded[i - urls.ORDER : i], padded[i])) - math.log(p(1, padded[i - urls.ORDER : i], padded[i])) for i in range(urls.ORDER, len(padded))]
        out[shape] = sum(logs) / len(logs) if shape else 0.0
    return out


def test_urls(spark, small):
    import hashlib

    given = [r.url for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    given += [None, "", "no scheme", "http://", "http://NET/a", "http://x.net", "http://x.net/?q", "https://a.b.Example.NET/en/x#y", "http://notnet/", "http://example.com/de/1", "ftp://u:p@w.ORG/fr/ü?x", "http://a\nb.net/c", "x://net/y://org/fr/"]
    rows = [(i, u, "<html>", u) for i, u in enumerate(given)] + [(0, given[0], "", None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    parts = {u: fold(u) for u in given}
    counts = defaultdict(lambda: [0, 0])
    for _, u, *_ in rows:
        host, path, shape = parts[u]
        says = brute_rule(host, path)[1]
        counts[shape][0] += says == "allow"
        counts[shape][1] += says == "block"
    held = {s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16) % urls.HELD_BACK == 0 for s in counts}
    scores = brute_scores(counts, [(s, *c) for s, c in counts.items() if not held[s] and sum(c)])
    accepted = []
    for r in got:
        host, path, shape = parts[given[r.page_id]]
        rule, says = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.score - scores[shape]) < 1e-5
        if says:
            assert r.verdict == says
        else:
            accepted.append((r.score, r.verdict == "allow"))
    assert [a for _, a in sorted(accepted)] == sorted(a for _, a in accepted)  # one cut parts them
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_vectors_with_clashing_columns_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0, 7, 8, 9), (2, b, 0, 7, 8, 9), (2, c, 0, 7, 8, 9), (3, c, 0, 7, 8, 9), (None, a, 0, 7, 8, 9), (None, None, 0, 7, 8, 9), (4, a, None, 7, 8, 9), (1, a, 0, 7, 8, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int, class int, block int")
    got = Counter(tuple(r) for r in embeddings.near_vectors(frame).collect())
    # Rows of id 2 are one node of the component, but count their own links.
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (2, 3, 1, False), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (4, 0, 4, True)])


def test_urls_with_clashing_columns(spark):
    rows = [(i, f"https://a{i}.net/x/{i % 7}") for i in range(30)] + [(30 + i, f"https://b{i}.org/fr/y{i % 7}") for i in range(30)] + [(90, "https://c.de/z"), (91, None), (None, "")]
    plain = sorted(map(str, urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()))
    more = spark.createDataFrame([(*r, "p", "q", "r", 1.0, "s") for r in rows], "page_id long, url string, path string, rule string, shape string, score double, gram string")
    assert sorted(map(str, urls.judge(more).collect())) == plain and len(plain) == len(rows)


def check_pipeline(spark, sf_dir):
    """Each stage against an independent version of its operator, over the rows that its predecessor gave."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    count = lambda rows: Counter((r[0], r[1]) for r in rows)
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.schema == docs.schema
            after = out.collect()
            docs = spark.createDataFrame(after, out.schema)
            after = [(r.doc_id, r.text, r.source) for r in after]
        if name == "quality_classifier":
            assert count(after) == count([r for r, p in zip(before, plain_quality(before, labels), strict=True) if p >= rules.CUTOFF])
        elif name == "exact_dedup":
            assert count(after) == count(stay_exact(before))
        elif name == "ngram_jaccard":
            free, groups = stay_near(before, 5, 80)
            left = count(after)
            left.subtract(count(free))
            for group in groups:
                assert sum(left.pop(r, 0) for r in group) == 1
            assert not +left and not -left
        elif name == "mixing":
            want = Counter()
            for r, (_, copies) in zip(before, plain_mix(before), strict=True):
                want[r] += copies
            assert Counter(after) == +want
        else:
            t, want = Tokenizer.from_file(BPE), Counter()
            for r in before:
                n = len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1
                for at in range(0, n, 2048):
                    want[(r[0], at, min(2048, n - at), n)] += 1
            rows = out.collect()
            assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows) == want
            at = defaultdict(list)
            for r in rows:
                at[r.sequence_id].append((r.offset, r.length))
            assert all(sum(n for _, n in sorted(v)[:i]) == o for v in at.values() for i, (o, _) in enumerate(sorted(v))) and sorted(at) == list(range(len(at)))
        made[name] = out
    assert made["packing"].count() == corpus_pipeline.run(spark, sf_dir).count()


def test_pipeline_against_brute_force(spark, small):
    check_pipeline(spark, small)


def test_pipeline_on_edges_and_on_nothing(spark, tmp_path):
    rows = edge_rows() + [(None if r[0] is None else 100 + r[0], r[1], "en", "ab"[i % 2], 0, 1, 2, 3, 1, "k", i) for i, r in enumerate(repeated_rows())]
    for name, given in (("edges", rows), ("nothing", [])):
        spark.createDataFrame(given, DOC).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(13)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        check_pipeline(spark, f"{tmp_path}/{name}")


def test_queries_leave_only_what_they_read(spark, small, tmp_path, monkeypatch):
    import shutil

    import __spark_entry__ as e

    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    for name, query in e.queries().items():
        if name == "pipeline" or name.startswith("op"):
            out = query(spark, small)
            read = {f.removeprefix("file://").rpartition("/")[0] for f in out.inputFiles()}
            assert {str(p) for p in tmp_path.iterdir()} <= read, name
            for p in tmp_path.iterdir():
                shutil.rmtree(p)
    bad = tmp_path / "in"
    for table in ("documents", "embeddings", "pages", "labels"):
        frame = spark.read.parquet(f"{small}/{table}.parquet")
        key = frame.columns[0]
        frame.write.parquet(f"{bad}/{table}.parquet")
        frame.limit(5).withColumn(key, frame[key].cast("string")).write.mode("append").parquet(f"{bad}/{table}.parquet")  # can't be read as what it is said to be
    for name, query in e.queries().items():
        if name in ("op3_ngram_jaccard", "op4_embedding_near_dedup", "op7_url_filter", "op8_exact_dedup", "pipeline"):
            with pytest.raises(Exception):  # noqa: B017
                query(spark, str(bad)).collect()
            assert [p.name for p in tmp_path.iterdir()] == ["in"], name


def test_query_names():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
