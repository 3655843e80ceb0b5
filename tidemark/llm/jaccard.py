"""Operator 3: n-gram Jaccard join, exact up to components, by relations between sets.

A document's set holds the hashes of its distinct k-word shingles, ordered by rarity (how often the shingle's
rarest word occurs in the whole corpus, then hash). Sets of one content are one class. Two classes that reach the
similarity share a token in the first n - ceil(t n) + 1 of each: these prefixes make the inverted lists.

Relations between sets save the rest of the work:

* answer level: every list names a pivot, the set that shares most of its prefix, and sets whose lists agree on a
  pivot meet in its bucket. There the pivot's answers, its overlaps with all the others, are counted from inverted
  lists. The answers of the set most like the one before follow from those by the lists of the few tokens in which the
  two differ. Sets linked to the pivot, at once or by others, need no answers of their own, as a link between two of
  them would join nothing. A bucket of more than BLOCK shingles or SETS sets is dealt into blocks that all hold
  the pivot; only sets that its own block leaves apart from the pivot go on to the other blocks;
* index level: what is left are lists whose sets lie in different components. A list is kept in blocks by set size and
  position. A probe first meets the heads of the blocks (largest and smallest size, first position, most tokens before
  it) and opens only blocks that can hold a partner: up to a common token at places pa and pb two sets share at
  most the tokens before it that stand in any other prefix at all, and behind it at most the shorter rest.

All pairs that are left so are examined, so components are exact. Pairs inside components or buckets are never made.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, chunks, claim, cut, drop, meet, offsets_and_bytes, text_keys
from tidemark.llm.components import connected
from tidemark.llm.words import Lookup, frequent, sequence_hash, shingles, word_hashes

#: Most frequent words whose counts order the shingles; the rest count as equally rare. 3 MB on each worker.
HEAD = 1 << 18
#: Rounds of buckets: a second and third only if more than PAIRS_PER_ENTRY pairs for each list entry remain.
ROUNDS, PAIRS_PER_ENTRY = 3, 30
#: Shingles and sets of a block of a bucket.
BLOCK, SETS = 400_000, 20_000
#: Rows of the table of documents to compare that may be broadcast: 60 bytes each.
BROADCAST_ROWS = 1_000_000


def frequent_words(rows: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the corpus's most frequent words, over all documents (at most `head` reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text", 4 << 20):
                words = word_hashes(*offsets_and_bytes(b.column(0)))[0]
                h, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts, path = cut(rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word_counts")
    got = frequent(counts, head)
    drop(rows.sparkSession, path)
    return got


class Shingler:
    """Texts to sets: sorted distinct tokens, the rarest first."""

    def __init__(self, k: int, head: tuple[np.ndarray, np.ndarray]):
        self.k, self.lookup = k, Lookup(head[0])
        self.level = np.append(np.minimum(63, 1 + 2 * np.log2(head[1])).astype(np.uint64), np.uint64(0))  # the last: any other word

    def __call__(self, col: pa.Array) -> list[np.ndarray]:
        words, before = word_hashes(*offsets_and_bytes(col))
        level = self.level[self.lookup(words)]
        least = level[: max(0, len(words) - self.k + 1)].copy()
        for i in range(1, self.k):
            np.minimum(least, level[i : len(least) + i], out=least)
        tokens = (least << np.uint64(58)) | (shingles(words, self.k) >> np.uint64(6))
        out = []
        for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if z - a >= self.k:
                out.append(np.unique(tokens[a : z - self.k + 1]))
            else:
                out.append(np.array([sequence_hash(words[a:z]) >> 6], np.uint64) if z > a else np.zeros(0, np.uint64))
        return out


_ready: list = []


def _shingler(k: int, head) -> Shingler:
    """The worker's shingler for this broadcast; groups are many and its tables not free."""
    claim("jaccard", _ready.clear)
    if not _ready or _ready[0] is not head.value or _ready[1] != k:
        _ready[:] = [head.value, k, Shingler(k, head.value)]
    return _ready[2]


def _need(num: int, den: int):
    """Least overlap of sets of na and nb tokens that reaches num / den."""
    return F.expr(f"(({num}L * (na + nb) + {num + den - 1}) div {num + den})")


def sign(rows: DataFrame, k: int, num: int, den: int, head) -> DataFrame:
    """rid, doc_id, k1, k2, set size n, set hash uid (null for an empty set) and prefix of each document.

    rid numbers the rows; the table must be written once. Of several copies that one task meets only the first
    carries the prefix.
    """

    def run(batches):
        make, met, row = _shingler(k, head), set(), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in chunks(whole, "text"):
                sets = make(b.column(1))
                ids, parts = [], []
                for s in sets:
                    n = len(s)
                    uid = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
                    ids.append(uid)
                    if uid is None or uid in met:
                        parts.append(None)
                        continue
                    met.add(uid)
                    parts.append(s[: n - (num * n + den - 1) // den + 1].view(np.int64))
                if len(met) > 500_000:
                    met.clear()
                ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *(p for p in parts if p is not None)])
                rid = pa.array(np.arange(row, row + len(sets)))
                row += len(sets)
                mask = pa.array([p is None for p in parts])
                yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(2), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=mask)], ["rid", "doc_id", "k1", "k2", "n", "uid", "prefix"])

    return rows.mapInArrow(run, "rid long, doc_id long, k1 long, k2 long, n long, uid binary, prefix array<long>")


def _few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast while it is small."""
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def _texts(uids: DataFrame, rows: DataFrame, sig: DataFrame) -> tuple[DataFrame, list[str]]:
    """(uid, text) of each class named by the rid of its first document; and the paths of the tables behind it."""
    own, own_path = cut(sig.select(F.col("rid").alias("uid"), "doc_id", "k1", "k2").join(_few(uids), "uid"), "wanted")
    wanted = _few(own)
    same = rows["k1"].eqNullSafe(wanted["k1"]) & rows["k2"].eqNullSafe(wanted["k2"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    whole, path = cut(rows.join(wanted, same).select("uid", "text"), "texts")
    paths = [own_path, path]
    if whole.count() > own.count():  # rows that repeat with their id
        whole, path = cut(whole.dropDuplicates(["uid"]), "texts")
        paths.append(path)
    return whole, paths


def overlaps(pairs: DataFrame, rows: DataFrame, sig: DataFrame, k: int, head) -> DataFrame:
    """(a, b, na, nb, o) for pairs of classes (a, b, na, nb): o is the true overlap of their whole sets."""
    whole, paths = _texts(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), rows, sig)
    both = _few(pairs).join(whole.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(whole.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches):
        make, kept = _shingler(k, head), OrderedDict()
        for whole in batches:
            for b in chunks(whole, "ta"):
                left, right, new = make(b.column(4)), b.column(1).to_pylist(), {}
                for i, uid in enumerate(right):
                    if uid not in kept and uid not in new:
                        new[uid] = i
                if new:
                    for uid, s in zip(new, make(b.column(5).take(pa.array(list(new.values())))), strict=True):
                        kept[uid] = s
                o = [len(np.intersect1d(x, kept[uid], assume_unique=True)) for x, uid in zip(left, right, strict=True)]
                while len(kept) > 64:
                    kept.popitem(last=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(o, pa.int64())], ["a", "b", "na", "nb", "o"])

    out, _ = cut(both.mapInArrow(run, "a long, b long, na long, nb long, o long"), "overlaps")
    drop(rows.sparkSession, *paths)
    return out


class Answers:
    """Overlaps of sets with all the sets of a bucket, each derived from the one before. Memory is linear in the sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        self.size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(self.m, dtype=np.int32), self.size)
        _, token, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        # tokens of one set have no list
        shared = times[token] > 1
        self.sets = np.split(token[shared], np.cumsum(np.bincount(owner[shared], minlength=self.m))[:-1])
        order = np.argsort(token, kind="stable")
        self.owners, self.ends = owner[order], np.concatenate(([0], np.cumsum(times)))
        self.marked = np.zeros(len(times), bool)
        self.now, self.overlap = -1, np.zeros(self.m, np.int64)

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of these tokens each set has, from their lists."""
        length = self.ends[tokens + 1] - self.ends[tokens]
        upto = np.cumsum(length)
        at = np.repeat(self.ends[tokens] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)
        return np.bincount(self.owners[at], minlength=self.m)

    def _beyond(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.marked[b] = True
        out = a[~self.marked[a]]
        self.marked[b] = False
        return out

    def ask(self, i: int) -> np.ndarray:
        """Overlaps of set i with every set, its own shared tokens included."""
        new = self.sets[i]
        if self.now >= 0:
            old = self.sets[self.now]
            more, less = self._beyond(new, old), self._beyond(old, new)
            if len(more) + len(less) < len(new):
                self.overlap = self.overlap + self._count(more) - self._count(less)
                self.now = i
                return self.overlap
        self.now, self.overlap = i, self._count(new)
        return self.overlap


def spanning(sets: list[np.ndarray], num: int, den: int, first: int = 0, ask: np.ndarray | None = None) -> np.ndarray:
    """For each set the least place that links reach, from the answers of the sets `ask` (None: whatever is needed).

    Starting from `first`, the set that is most like the last one asked is next; sets already in the component of
    `first` aren't asked, unless named.
    """
    answers = Answers(sets)
    label = np.arange(answers.m)
    open_ = np.ones(answers.m, bool)
    if ask is not None:
        open_[:] = False
        open_[ask] = True
        first = int(ask[0])
    i = first
    while True:
        o = answers.ask(i)
        open_[i] = False
        linked = o * (num + den) >= num * (answers.size + answers.size[i])
        linked[i] = True
        classes = np.unique(label[linked])
        if len(classes) > 1:
            label[np.isin(label, classes)] = classes[0]
        left = np.flatnonzero(open_ & (label != label[first]) if ask is None else open_)
        if not len(left):
            return label
        i = int(left[np.argmax(o[left] / (answers.size[left] + answers.size[i] - o[left]))])


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, blocks, size) of members (uid, n, bucket)."""
    need = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(SETS)))
    return members.groupBy("bucket").agg(need.cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")


def solve_buckets(members: DataFrame, rows: DataFrame, sig: DataFrame, k: int, num: int, den: int, head) -> DataFrame:
    """Links (u, v) that span the components inside each bucket of members (uid, n, bucket)."""
    spark = rows.sparkSession
    sized = _blocks(members)
    deal = lambda df, to: df.withColumn(to, F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    placed = deal(members.join(sized, "bucket"), "i").select("uid", "n", "bucket", "i")
    pivots = sized.select(F.col("bucket").alias("uid"), F.lit(0).alias("n"), "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    placed = placed.join(pivots.select("uid", "bucket", "i"), ["uid", "bucket", "i"], "left_anti").unionByName(pivots)
    placed, placed_path = cut(placed, "placed")
    whole, paths = _texts(placed.select("uid").distinct(), rows, sig)

    def solve(t: pa.Table) -> pa.Table:
        """Links; in place of its link, null for a set that stays apart from the pivot."""
        uids, sets = t.column("uid").to_numpy(), _shingler(k, head)(t.column("text").combine_chunks())
        pivot = int(np.flatnonzero(uids == t.column("bucket")[0].as_py())[0])
        label = spanning(sets, num, den, pivot)
        at = np.flatnonzero(label != np.arange(len(sets)))
        apart = np.flatnonzero(label != label[pivot])
        v = pa.array(np.append(uids[label[at]], np.zeros(len(apart), np.int64)), mask=np.arange(len(at) + len(apart)) >= len(at))
        return pa.table({"u": uids[np.append(at, apart)], "v": v})

    out, out_path = cut(_few(placed).join(whole, "uid").groupBy("bucket", "i").applyInArrow(solve, "u long, v long"), "bucket_links")
    links = out.where("v is not null")
    wide = sized.where("blocks > 1").select("bucket", F.col("blocks").alias("all"))
    apart = members.join(out.where("v is null").select(F.col("u").alias("uid")), "uid").join(wide, "bucket").select("uid", "n", "bucket", "all")
    apart, apart_path = cut(apart, "apart")
    if apart.limit(1).count():
        # sets apart from the pivot against the other blocks of their bucket
        parts = _blocks(apart).unionByName(apart.groupBy("bucket").agg(F.lit(1).alias("blocks"), F.count("*").alias("size")).where("size = 1"))
        asked = deal(apart.join(parts, "bucket"), "g").select("uid", "bucket", "g", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("i"), F.lit(True).alias("ask"))
        there = placed.join(parts, "bucket").select("uid", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g"), "i", F.lit(False).alias("ask"))
        both, both_path = cut(asked.unionByName(there).groupBy("uid", "bucket", "g", "i").agg(F.max("ask").alias("ask")), "both")

        def cross(t: pa.Table) -> pa.Table:
            uids, sets = t.column("uid").to_numpy(), _shingler(k, head)(t.column("text").combine_chunks())
            asked = np.flatnonzero(t.column("ask").to_numpy())
            label = spanning(sets, num, den, ask=asked) if len(asked) else np.arange(len(sets))
            at = np.flatnonzero(label != np.arange(len(sets)))
            return pa.table({"u": uids[at], "v": uids[label[at]]})

        more, _ = cut(both.join(whole, "uid").groupBy("bucket", "g", "i").applyInArrow(cross, "u long, v long"), "cross_links")
        links = links.unionByName(more)
        paths.append(both_path)
    drop(spark, placed_path, apart_path, *paths)
    return links


def _classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """rid, doc_id, k1, k2, n and comp (the class that names the component; null for empty sets) of every row.

    Within, a class goes by the rid of its first document: its row number. Copies of one set may be a large part of all
    rows, so rows find their class by `meet`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *text_keys(text))
    head = spark.sparkContext.broadcast(frequent_words(rows))
    sig, _ = cut(sign(rows, k, num, den, head), "sets")
    firsts = sig.where("prefix is not null").select("rid", "uid")
    again, again_path = cut(firsts.groupBy("uid").agg(F.min("rid").alias("first"), F.count("*").alias("c")).where("c > 1").select("uid", "first"), "again")
    entries = sig.where("prefix is not null").join(_few(again), "uid", "left").where("first is null or first = rid")
    entries = entries.select(F.col("rid").alias("uid"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")  # a class has a token once
    lists = entries.join(shared, "token").select("token", "uid", "n", "pos")
    # before: tokens in front of this one that other prefixes have too; share: all of them, for the size
    lists = lists.withColumn("before", F.row_number().over(Window.partitionBy("uid").orderBy("pos")) - 1).withColumn("share", F.count("*").over(Window.partitionBy("uid")) / F.col("n"))
    lists, lists_path = cut(lists, "lists")
    nodes, nodes_path = cut(lists.groupBy("uid").agg(F.max("n").alias("n")).select("uid", "n", F.col("uid").alias("comp"), F.array().cast("array<long>").alias("met")), "nodes")
    n_entries = lists.count()
    need = _need(num, den)
    fits = (F.col("nb") * num <= F.col("na") * den) & (F.col("na") * num <= F.col("nb") * den)
    possible = fits & (F.least("va", "vb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)

    def join_components(links: DataFrame, extra) -> None:
        """Update the nodes by links between classes."""
        nonlocal nodes, nodes_path
        comp = nodes.select("uid", "comp")
        ends = links.join(comp.select(F.col("uid").alias("u"), F.col("comp").alias("cu")), "u").join(comp.select(F.col("uid").alias("v"), F.col("comp").alias("cv")), "v")
        roots = connected(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        new = extra(nodes.join(roots, nodes["comp"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "comp")))
        new, path = cut(new.select("uid", "n", "comp", "met"), "nodes")
        drop(spark, nodes_path)
        nodes, nodes_path = new, path

    open_path = None
    for turn in range(ROUNDS + 1 if n_entries else 0):
        # lists with sets of more than one component, in the first round all
        open_lists = lists.withColumn("comp", F.col("uid"))
        if turn:
            known = lists.join(nodes.select("uid", "comp", "met"), "uid")
            mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
            before_path = open_path
            open_lists, open_path = cut(known.join(mixed, "token"), "open_lists")
            if before_path:
                drop(spark, before_path)
            per = open_lists.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"))
            cross = per.agg(F.sum((F.col("all").cast("double") * F.col("all") - F.col("own")) / 2)).first()[0] or 0
            if cross <= PAIRS_PER_ENTRY * n_entries or turn == ROUNDS:
                break
        known = open_lists
        first = F.col("share") if turn == 0 else F.lit(0.0)
        pivots = known.groupBy("token").agg(F.max(F.struct(first.alias("s"), F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "n", "pos", "before")).alias("p"))
        pivots = pivots.select("token", F.col("p.uid").alias("b"), F.col("p.n").alias("nb"), F.col("p.pos").alias("pb"), F.col("p.before").alias("vb"))
        found = known.join(pivots, "token").withColumnsRenamed({"n": "na", "pos": "pa", "before": "va"}).where(possible | (F.col("uid") == F.col("b")))
        bucket = found.groupBy("uid", "b").agg(F.count("*").alias("c"), F.max("na").alias("n")).groupBy("uid").agg(F.max(F.struct("c", "b", "n")).alias("q"))
        members, members_path = cut(bucket.select("uid", F.col("q.n").alias("n"), F.col("q.b").alias("bucket")), "members")
        links = solve_buckets(members, rows, sig, k, num, den, head)
        place = members.select(F.col("uid").alias("m"), "bucket")
        join_components(links, lambda df, place=place: df.join(place, df["uid"] == place["m"], "left").withColumn("met", F.concat("met", F.array(F.coalesce("bucket", "uid")))))
        drop(spark, members_path)
    if n_entries:
        block = F.floor(F.log("n") / (math.log(den / num) * 1.0001)).cast("int")
        known = open_lists
        names = lambda x: [F.col(c).alias(c[0] + x if c != "before" else "v" + x) for c in ("n", "pos", "before", "comp", "met")]
        left = known.where(F.expr(f"pos < n - (2 * {num}L * n + {num + den - 1}) div {num + den} + 1")).select("token", block.alias("block"), F.col("uid").alias("a"), *names("a"))
        # a list's blocks: by size, each size's by position in eighths of it; a probe of one size opens two sizes
        eighth = F.floor(F.col("pos") * 8 / F.col("n")).cast("int")
        right = known.select("token", F.explode(F.array(block, block - 1)).alias("block"), eighth.alias("skip"), F.col("uid").alias("b"), *names("b"))
        heads = right.groupBy("token", "block", "skip").agg(F.min("nb").alias("least"), F.max("nb").alias("most"), F.max(F.col("nb") - F.col("pb")).alias("rest"), F.max("vb").alias("front"), F.min("cb").alias("lo"), F.max("cb").alias("hi"))
        opens = F.least("va", "front") + F.least(F.col("na") - F.col("pa"), F.col("rest")) >= F.expr(f"(({num}L * (na + least) + {num + den - 1}) div {num + den})")
        opens = opens & (F.col("most") >= F.col("na")) & ((F.col("lo") < F.col("hi")) | (F.col("lo") != F.col("ca")))
        left = left.join(heads, ["token", "block"]).where(opens).drop("least", "most", "rest", "front", "lo", "hi")
        larger = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        apart = F.col("ca") != F.col("cb")
        for turn in range(ROUNDS):
            apart = apart & ~F.coalesce(F.get("ma", F.lit(turn)) == F.get("mb", F.lit(turn)), F.lit(False))
        found = left.join(right, ["token", "block", "skip"]).where(larger & apart & possible)
        bound = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
        pairs = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("na").alias("na"), F.min("nb").alias("nb")).where(bound >= need).select("a", "b", "na", "nb")
        pairs, pairs_path = cut(pairs, "pairs")
        met = overlaps(pairs, rows, sig, k, head)
        join_components(met.where(F.col("o") >= need).select(F.col("a").alias("u"), F.col("b").alias("v")), lambda df: df)
        drop(spark, pairs_path, open_path)
    drop(spark, lists_path, again_path)
    comps = sig.where("uid is not null").groupBy("uid").agg(F.min("rid").alias("first"), F.count("*").alias("c"))
    comps = comps.join(nodes.select(F.col("uid").alias("first"), "comp"), "first", "left").select("uid", F.coalesce("comp", "first").alias("comp"), "c")
    comps, _ = cut(comps, "classes_of_sets")
    return meet(sig.drop("prefix"), comps, "uid", "rid").select("rid", "doc_id", "k1", "k2", "n", "comp")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: links are den * |A & B| >= num * |A or B|.

    Words are split at white space with A-Z lowered; a text of fewer words than k is one shingle, and a null or
    empty text has none, links to nothing and is its own component. component_id is the smallest doc_id of the
    component; null ids take part but never name one, unless all are null. Repeated rows give repeated results.
    Other columns of docs are not looked at. An empty table gives no rows.
    """
    rows, _ = cut(_classes(docs, k, num, den, id_col, text).select("rid", "doc_id", "n", "comp"), "classes")
    least, _ = cut(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")), "least")
    out = meet(rows, least, "comp", "rid")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs but for those whose component has a row before them in the order of id and text hash.

    All columns stay as they are. Documents with empty sets all stay, unless the whole row's id and text repeat; of
    such repeats one stays. Rows to leave out are broadcast only while they are few, and else met by a shuffle.
    """
    rows, path = cut(_classes(docs, k, num, den, id_col, text).select("rid", "doc_id", "k1", "k2", "comp"), "classes")
    first, first_path = cut(rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"), F.count("*").alias("c")), "first")
    out = meet(rows, first, "comp", "rid").where("first is not null").where(~F.struct("doc_id", "k1", "k2").eqNullSafe(F.col("first"))).select("doc_id", "k1", "k2").distinct()
    out, _ = cut(out, "left_out")
    again = rows.groupBy("doc_id", "k1", "k2").count().where("count > 1").limit(1).count() > 0
    drop(docs.sparkSession, path, first_path)
    keys = text_keys(text)
    marked = docs.select(F.struct(F.lit(True).alias("given"), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), *keys)
    if again:
        marked = marked.dropDuplicates(["doc_id", "k1", "k2"])
    few = F.broadcast(out) if bounded(out, BROADCAST_ROWS) else out
    same = marked["doc_id"].eqNullSafe(few["doc_id"]) & (marked["k1"] == few["k1"]) & (marked["k2"] == few["k2"])
    return marked.join(few, same, "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
