"""Similarity join on shingle sets by a grouped prefix join (operator 3).

Exact for the Jaccard threshold, given 64-bit hashes of shingles and of sets:

1. Counting: shingles with low hashes, and those frequent within any block of rows, are counted over the corpus; those in ``FREQUENT`` documents (the ``heavy``
   most frequent, a bounded broadcast) come last in the order of shingles, all others by hash. Any total order gives right results; this one keeps
   common passages and phrases out of prefixes.
2. Each document becomes size, fingerprint of its set and prefix. Equal sets collapse into a class, classes of equal size and prefix into a group.
3. Groups are listed by prefix shingle. Star round: in each list, every group meets only the smallest one. Pairs are filtered by size and by the
   overlap that their prefixes leave possible, expanded to members and verified on whole sets. Links make components.
4. Completion round: of each list only pairs in different components remain; they are filtered (pair-specific prefix lengths), expanded and
   verified likewise. So no pair that could join two components is left out, while a group of thousands of near copies costs one star. Lists of
   more than ``LIST`` groups are cut by size and into blocks, and every pair of blocks whose sizes may fit is a key of its own.

Defined results: a text without words (or null) has size 0 and is alone; fewer words than ``k`` are one shingle; rows that share a doc_id are one node of
near_components, whatever their texts; a null doc_id is alone unless its set occurs elsewhere; an empty table gives no rows; columns besides doc_id and text
are ignored. drop_near judges rows, not doc_ids: see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import Sieve, bounded_batches, ids_and_texts, row_order, whole_row
from crestline.llm.shingles import mix, sets
from crestline.operators.components import connected_components
from crestline.session import Scratch

HEAVY = 1 << 20  # 16 MB where it is broadcast
FREQUENT = 16  # documents from which a shingle counts as frequent
BLOCK = 4_000_000  # shingles counted at a time
PART = 1 << 17  # of them handed on at a time
LOCAL = 3  # occurrences in a block from which any shingle is reported
LOW = np.uint64(1 << 62)  # hashes below are always reported: by hash order these are the ones that get into prefixes
BROADCAST_IDS = 500_000
LIST = 2_000  # groups of a list that are compared under one key
SIGNATURE = "doc_id long, mark long, n long, f1 long, f2 long, p1 long, p2 long, prefix array<long>"


def _ceil(a: Column | int, b: int) -> Column:
    """Ceiling of a / b for integers."""
    return F.floor((a + (b - 1)) / b).cast("long")


def _sums(values: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Sum of mixed values of each set."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(values, seed), dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def heavy_shingles(docs: DataFrame, k: int, scratch: Scratch, heavy: int = HEAVY) -> np.ndarray:
    """The frequent shingles, at most ``heavy``, rarest first. Equal sets within a block count once. Counts are exact for the lowest quarter of hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0

        def report() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()  # sorted in place and handed on in parts: a block is all that a worker holds
            every.sort()
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
            got, times = every[first], np.diff(first, append=len(every))
            del every, first
            many = np.flatnonzero((times >= LOCAL) | (got < LOW))
            for some in (many[s : s + PART] for s in range(0, len(many), PART)):
                yield pa.RecordBatch.from_arrays([pa.array(got[some].view(np.int64)), pa.array(times[some].astype(np.int64))], names=["token", "times"])

        for b in batches:
            for _, _, sizes, values in sets(b.column(0), k):
                marks = _sums(values, sizes, 6)
                fresh = np.array([m not in seen and not seen.add(m) for m in marks.tolist()], dtype=bool)
                held.append(values[np.repeat(fresh, sizes)])
                n += len(held[-1])
                if n >= BLOCK:
                    yield from report()
                    n = 0
                    seen.clear()
        yield from report()

    counted = docs.select("text").mapInArrow(count, "token long, times long")
    frequent = scratch.put(counted.groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT), "frequent")
    most = frequent.orderBy(F.desc("times"), "token").limit(heavy) if frequent.count() > heavy else frequent
    top = most.toPandas().sort_values(["times", "token"])
    scratch.drop(frequent)
    return top["token"].to_numpy(np.int64).view(np.uint64)


def signatures(docs: DataFrame, k: int, percent: int, last: np.ndarray) -> DataFrame:
    """Size, fingerprint, prefix and fingerprint of the prefix of each row's set, and a hash of its text."""
    order = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[order], order + 1))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        for b in batches:
            for row, end, sizes, values in sets(b.column(2), k):
                rank = np.zeros(len(values), np.int64)
                if len(known) and len(values):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    hit = known[at] == values
                    rank[hit] = ranks[at[hit]]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                by = np.lexsort((values, rank, owner)) if rank.any() else np.arange(len(values))
                first = np.cumsum(sizes) - sizes
                length = np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)
                keep = np.arange(len(values)) - first[owner] < length[owner]
                prefix = values[by][keep]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(prefix.view(np.int64)))
                marks = [_sums(values, sizes, 7), _sums(values, sizes, 8), _sums(prefix, length, 9), _sums(prefix, length, 10)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), b.column(1).slice(row, end - row), pa.array(sizes.astype(np.int64)), *(pa.array(m.view(np.int64)) for m in marks), lists],
                    names=["doc_id", "mark", "n", "f1", "f2", "p1", "p2", "prefix"],
                )

    return ids_and_texts(docs).select("doc_id", _mark(F.col("text")).alias("mark"), "text").mapInArrow(sign, SIGNATURE)


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Sets of the documents in ids (one column: id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, sizes, values in sets(b.column(1), k):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), pa.array(_sums(values, sizes, 7).view(np.int64)), pa.array(_sums(values, sizes, 8).view(np.int64)), lists], names=["doc_id", "f1", "f2", "shingles"]
                )

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = ids_and_texts(docs).join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    return some.mapInArrow(run, "doc_id long, f1 long, f2 long, shingles array<long>")


class _Join:
    """One run of the join over docs."""

    def __init__(self, docs: DataFrame, k: int, percent: int, heavy: int, run: Scratch, by_document: bool):
        """by_document: rows that share a doc_id are linked."""
        bounded_batches(docs.sparkSession, "4m")
        self.docs, self.k, self.percent, self.scratch, self.by_document = docs, k, percent, run, by_document
        keep = self.scratch.put
        self.signed = keep(signatures(docs, k, percent, heavy_shingles(docs, k, self.scratch, heavy)), "signatures")
        known = self.signed.filter("n > 0 AND doc_id IS NOT NULL")
        classes = known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("rows"))
        if by_document:  # doc_ids with several sets, or with words in some of their rows only
            key = F.when(F.col("n") > 0, F.col("f1"))
            several = self.signed.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("d_id")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("n").alias("least"))
            self.several = keep(several.filter("lo <> hi OR least = 0 AND lo IS NOT NULL"), "several")
        classes = classes.withColumn("key", F.col("f1"))  # not rep: a doc_id with two texts can be the smallest of two classes
        groups = classes.groupBy("n", "p1", "p2").agg(F.min("key").alias("gid"))
        self.members = keep(classes.join(groups, ["n", "p1", "p2"]).select("key", "rep", "gid", "n", "f1", "f2", "rows"), "members")
        heads = self.members.filter("key = gid").select("gid", F.col("rep").alias("h_id"), F.col("f1").alias("h1"), F.col("f2").alias("h2"))
        own = self.signed.filter("n > 0").join(heads, (F.col("doc_id") == F.col("h_id")) & (F.col("f1") == F.col("h1")) & (F.col("f2") == F.col("h2")))
        self.groups = keep(own.select("gid", "n", "prefix").dropDuplicates(["gid"]), "groups")
        whole, self.signed = self.signed, keep(self.signed.drop("p1", "p2", "prefix"), "rows")
        run.drop(whole)
        run.sweep(docs.sparkSession)
        posts = self.groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = posts.groupBy(F.col("token").alias("l_token")).agg(F.count("*").alias("many"), F.min("pos").alias("first")).filter("many > 1")
        lists = posts.join(shared, F.col("token") == F.col("l_token")).select("token", "gid", "n", F.col("pos").cast("long").alias("pos"), (F.col("pos") == F.col("first")).alias("head"))
        self.lists = keep(lists, "lists")
        run.sweep(docs.sparkSession)

    def _need(self, a: Column, b: Column) -> Column:
        """Least overlap of linked sets of these sizes."""
        return _ceil((a + b) * self.percent, 100 + self.percent)

    def _fits(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs of groups (a, b) that their sizes and prefixes leave possible."""
        one = self.groups.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        two = self.groups.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        both = pairs.join(one, "a").filter(F.col("na") > 0).join(two, "b").filter(self._fits(F.col("na"), F.col("nb")))
        beyond = _ceil(F.greatest("na", "nb") * self.percent, 100) - 1  # most shingles that a set has behind its prefix
        return both.filter(F.size(F.array_intersect("pa", "pb")) >= self._need(F.col("na"), F.col("nb")) - beyond).select("a", "b")

    def same_document(self) -> DataFrame:
        """Links between the classes of each doc_id with several sets."""
        sets_of = self.several.filter("lo <> hi")
        own = self.signed.filter("n > 0").join(sets_of, F.col("doc_id") == F.col("d_id"))
        return self.scratch.put(own.filter("lo <> f1").select(F.col("lo").alias("a"), F.col("f1").alias("b")).distinct(), "same")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs of keys of classes (a, b). Sets of the first go to the second's, so a key of very many pairs should be a first one."""
        keep = self.scratch.put
        pairs = keep(pairs.filter("a <> b").select("a", "b").distinct(), "candidates")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        ids = keep(self.members.join(ids, F.col("key") == F.col("id")).select("key", F.col("rep").alias("id"), F.col("f1").alias("m1"), F.col("f2").alias("m2")), "ids")
        whole = _whole_sets(self.docs, ids.select("id"), self.k)
        whole = whole.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("f1") == F.col("m1")) & (F.col("f2") == F.col("m2")))
        whole = keep(whole.select("key", "shingles").dropDuplicates(["key"]), "sets")
        one, two = (whole.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        found = keep(both.filter(common * (100 + self.percent) >= (F.size("sa") + F.size("sb")) * self.percent).select("a", "b"), "links")
        self.scratch.drop(pairs, ids, whole)
        return found

    def components(self) -> DataFrame:
        """node (key of a class) and component (smallest key) of the classes that are linked to others."""
        keep, drop = self.scratch.put, self.scratch.drop
        # The group in whose prefix a list's token stands first leads the list: fewest rarer shingles come before, as in the text that near copies were made from.
        leaders = self.lists.filter("head").groupBy(F.col("token").alias("l_token")).agg(F.min("gid").alias("leader"))
        star = self.lists.join(leaders, F.col("token") == F.col("l_token")).filter("gid <> leader").select(F.col("leader").alias("a"), F.col("gid").alias("b")).distinct()
        star = keep(self._filtered(star), "star")
        inside = self.members.filter("key <> gid").select(F.col("gid").alias("a"), F.col("key").alias("b"))
        expanded = star.join(self.members.select(F.col("gid").alias("b"), "key"), "b").select("a", F.col("key").alias("b"))
        first = self.verified(expanded.unionByName(inside))
        if self.by_document:
            first = first.unionByName(self.same_document())
        drop(star)
        self.scratch.sweep(self.docs.sparkSession)

        found = keep(connected_components(first, lambda df: keep(df, "stars"), drop=drop), "found")
        placed = self.members.join(found, F.col("key") == F.col("node"), "left").select("key", "gid", F.coalesce("component", "key").alias("c"))
        placed = keep(placed, "placed")
        span = placed.groupBy("gid").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).withColumnRenamed("gid", "s_gid")
        lists = keep(self.lists.join(span, F.col("gid") == F.col("s_gid")).select("token", "gid", "n", "pos", "c0", "c1"), "spans")
        drop(self.lists)
        mixed = lists.groupBy(F.col("token").alias("m_token")).agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"), F.count("*").alias("many")).filter("lo <> hi")
        mixed = keep(mixed.select("m_token", "many"), "mixed")
        pairs = self._possible(lists.join(mixed.filter(F.col("many") <= LIST), F.col("token") == F.col("m_token")), ["token"], F.col("gid_x") < F.col("gid_y"))
        if not mixed.filter(F.col("many") > LIST).isEmpty():
            long = lists.join(mixed.filter(F.col("many") > LIST), F.col("token") == F.col("m_token"))
            pairs = pairs.unionByName(self._long_pairs(long.select("token", "gid", "n", "pos", "c0", "c1")))
        pairs = keep(self._filtered(pairs.distinct()), "cross")
        drop(lists, mixed, self.groups)
        self.scratch.sweep(self.docs.sparkSession)
        left = placed.select(F.col("gid").alias("a"), F.col("key").alias("ra"), F.col("c").alias("ca"))
        right = placed.select(F.col("gid").alias("b"), F.col("key").alias("rb"), F.col("c").alias("cb"))
        apart = pairs.join(left, "a").join(right, "b").filter("ca <> cb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        torn = left.join(right.withColumnRenamed("b", "a"), "a").filter("ca < cb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        # What this finds joins components as a whole, so only those are searched again.
        more = self.verified(apart.unionByName(torn))
        more = more.join(left.select(F.col("ra").alias("a"), "ca"), "a").join(right.select(F.col("rb").alias("b"), "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = keep(connected_components(more, lambda df: keep(df, "rounds"), drop=drop).toDF("j_node", "j_component"), "joined")
        old = found.join(joined, F.col("component") == F.col("j_node"), "left").select("node", F.coalesce("j_component", "component").alias("component"))
        new = joined.join(found, F.col("j_node") == F.col("node"), "left_anti").select(F.col("j_node").alias("node"), F.col("j_component").alias("component"))
        return keep(old.unionByName(new), "components")

    def _possible(self, lists: DataFrame, keys: list[str], order: Column, others: DataFrame | None = None) -> DataFrame:
        """Pairs of groups (a, b) under one key that their sizes, positions and components leave possible."""
        x, y = (side.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in ("gid", "n", "pos", "c0", "c1")]) for side, name in ((lists, "x"), (lists if others is None else others, "y")))
        n, m = F.col("n_x"), F.col("n_y")
        need = self._need(n, m)
        apart = (F.col("c0_x") != F.col("c1_y")) | (F.col("c1_x") != F.col("c0_y"))
        fits = order & apart & self._fits(n, m) & (F.col("pos_x") <= n - need) & (F.col("pos_y") <= m - need)
        return x.join(y, keys).filter(fits).select(F.least("gid_x", "gid_y").alias("a"), F.greatest("gid_x", "gid_y").alias("b")).distinct()

    def long_lists(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides of the join of long lists: sizes that fit lie in one class of sizes or in neighbouring ones (step 0 or 1), and classes are cut into
        blocks; a row goes to every block of the other side, under keys token, low (the smaller class), step, left and right (blocks)."""
        width = max(math.log(100 / self.percent), 0.01) * 1.0001  # a little wide, so that rounding can't part sizes that fit
        sized = lists.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
        counts = sized.groupBy("token", "size").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
        counts = self.scratch.put(counts, "blocks")
        own = sized.join(counts, ["token", "size"]).withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        sides = []
        for name, away in (("left", 1), ("right", -1)):
            both = own.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("o_size", F.col("size") + away * F.col("step"))
            there = counts.select("token", F.col("size").alias("o_size"), F.col("blocks").alias("o_blocks"))
            met = both.join(there, ["token", "o_size"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)))
            mine, others = (F.col("block"), F.col("other")) if name == "left" else (F.col("other"), F.col("block"))
            sides.append(met.select("token", F.least("size", "o_size").alias("low"), "step", mine.alias("left"), others.alias("right"), "gid", "n", "pos", "c0", "c1"))
        return sides[0], sides[1]

    def _long_pairs(self, lists: DataFrame) -> DataFrame:
        left, right = self.long_lists(lists)
        return self._possible(left, ["token", "low", "step", "left", "right"], (F.col("step") == 1) | (F.col("gid_x") < F.col("gid_y")), right)


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; sets link at a Jaccard similarity of percent / 100 or more."""
    with Scratch() as run:
        join = _Join(docs, k, percent, heavy, run, True)
        placed = join.members.join(join.components(), F.col("key") == F.col("node"), "left").select("rep", "n", "f1", "f2", F.coalesce("component", "key").alias("c"), F.col("component").isNotNull().alias("linked"))
        placed = run.put(placed, "placed")
        names = run.put(placed.filter("linked").groupBy(F.col("c").alias("n_c")).agg(F.min("rep").alias("name")), "names")
        named = placed.join(names, F.col("c") == F.col("n_c"), "left").select(F.col("n").alias("c_n"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("name", "rep").alias("component_id"))
        named = run.put(named, "named")
        some = join.signed.filter("n > 0").select("doc_id", "n", "f1", "f2")
        joined = some.join(named, (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
        joined = joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        none = join.signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"))
        # A document whose rows are empty in part is in the component of its other rows.
        partly = run.put(join.several.filter("least = 0").join(named, F.col("lo") == F.col("c1")).select(F.col("d_id").alias("e_id"), F.col("component_id").alias("e_component")), "partly")
        none = none.join(partly, F.col("doc_id") == F.col("e_id"), "left").select("doc_id", "n_shingles", F.coalesce("e_component", "doc_id").alias("component_id"))
        return run.leave(joined.unionByName(none), join.signed, named, partly)


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, heavy: int = HEAVY) -> DataFrame:
    """docs with one row of each component of texts: that with the smallest doc_id, then the smallest hashes of its set and text, then the smallest values in
    its other columns. Only texts link here: rows that share a doc_id with different texts are judged each by its own. Rows without words or without a
    doc_id all stay. Rows that aren't near copies of others pass through a sieve and aren't shuffled."""
    with Scratch() as run:
        join = _Join(docs, k, percent, heavy, run, False)
        placed = join.members.join(join.components(), F.col("key") == F.col("node"), "left")
        placed = run.put(placed.filter("node IS NOT NULL OR rows > 1").select("rep", "key", "n", "f1", "f2", F.coalesce("component", "key").alias("c")), "placed")
        stays = run.put(placed.groupBy(F.col("c").alias("s_c")).agg(F.min(F.struct("rep", "key")).alias("best")), "stays")
        judged = placed.join(stays, F.col("c") == F.col("s_c")).select(F.col("n").alias("j_n"), F.col("f1").alias("j1"), F.col("f2").alias("j2"), F.col("best.rep").alias("s_rep"), F.col("best.key").alias("s_key"))
        rows = join.signed.filter("n > 0 AND doc_id IS NOT NULL").join(judged, (F.col("n") == F.col("j_n")) & (F.col("f1") == F.col("j1")) & (F.col("f2") == F.col("j2")))
        rows = rows.groupBy("doc_id", "mark", "f1", "s_rep", "s_key").agg(F.count("*").alias("times"))
        rows = run.put(rows.withColumn("may", (F.col("doc_id") == F.col("s_rep")) & (F.col("f1") == F.col("s_key"))), "rows")
        best = rows.filter("may").groupBy(F.col("f1").alias("b1")).agg(F.min("mark").alias("b_mark"))
        fate = rows.join(best, (F.col("f1") == F.col("b1")) & F.col("may"), "left").select(F.col("doc_id").alias("v_doc"), F.col("mark").alias("v_mark"), "times", (F.col("may") & (F.col("mark") == F.col("b_mark"))).alias("stay"))
        fate = run.put(fate.select("v_doc", "v_mark", "times", F.coalesce("stay", F.lit(False)).alias("stay")).filter("NOT stay OR times > 1"), "fate")
        base = docs.select(whole_row(docs), docs["doc_id"].cast("long").alias("__doc"), _mark(docs["text"].cast("string")).alias("__mark"), row_order(docs).alias("__more"))
        base = Sieve.of(fate, F.xxhash64("v_doc", "v_mark")).marked(base, F.xxhash64("__doc", "__mark"))
        met = base.filter("__maybe").join(fate, (F.col("__doc") == F.col("v_doc")) & (F.col("__mark") == F.col("v_mark")), "left")
        out = base.filter("NOT __maybe").select("__row").unionByName(met.filter("v_doc IS NULL").select("__row"))
        if not fate.filter("stay").isEmpty():  # rows that repeat one that stays
            out = out.unionByName(met.filter("stay").groupBy("__doc", "__mark").agg(F.min_by("__row", "__more").alias("__row")).select("__row"))
        return run.leave(out.select("__row.*"), fate)


def op3_query(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS shingles FROM w
), n AS (
  SELECT doc_id, len(shingles)::BIGINT AS n FROM s
), e AS (
  SELECT doc_id, unnest(shingles) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
