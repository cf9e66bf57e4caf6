"""N-gram Jaccard join by a token-group matrix, and the classes that its links make.

Equal shingle sets are one class before anything is joined. Each class keeps a prefix of its set in one order for all
(tokens that very many texts have come last): of two sets that reach the similarity, the prefixes share some tokens, a
number that grows with the sets. Classes that share enough prefix tokens are dealt into groups of similar ones. For each
group the union of its members' tokens is held, first of their prefixes, then of their sets: a query's overlap with the
union bounds its overlap with every member, and only groups that reach the bound are sent the query and opened for it.

Groups are opened in two rounds. In the first each links its own members, and a few leaders of every group are its only
queries to others. What they connect needs no more comparing: in the second round a class is sent to a group only if not
all of the group's members are in its own component already. So a family of near copies that fills many groups is joined
through the leaders, and no member of it is sent to all of them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquery.llm.common import annotate, chunks, quoted, written
from docquery.llm.textkernels import shingle_sets, words

#: Shingles that a task counts at once for the list of very common ones, and the count from which it reports one.
COUNT_AT_ONCE, REPORT_FROM = 1 << 22, 8
#: A shingle is very common from this count, or from this share of all shingles: the list has at most 1 / share entries.
COMMON_FROM, COMMON_SHARE = 64, 2.0**-18
#: Tokens of the members of one group; larger groups are split by a hash.
GROUP_TOKENS = 1 << 21
#: Groups to be split whose list is broadcast; a longer list is joined.
LISTED_GROUPS = 200_000
#: Members of a group that are its queries to other groups in the first round.
LEADERS = 2
#: Tokens of the sets that a task of a round is sent, about.
TASK_TOKENS = 1 << 24


def sets_of(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    return shingle_sets(words(texts, lower=True), size)


def need(n: int, num: int, den: int) -> int:
    """The least overlap with a set of n tokens at the similarity num / den."""
    return -(-num * n // den)


def overlap(n):
    """How many tokens the prefixes of two sets share at least, the smaller of n tokens: see prefix_length."""
    return n // 32 + 1


def prefix_length(n: int, num: int, den: int) -> int:
    """Of sets x and y with x & y at least need(x) and need(y), take the first i common tokens, i up to overlap of both.

    After the last of them x has at least need(x) - i tokens, so all i are among its first len(x) - need(x) + i.
    """
    return min(n, n - need(n, num, den) + overlap(n))


def common_shingles(documents: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted hashes of shingles that very many texts have. Only the order of tokens depends on it, never a result."""
    schema = T.StructType.fromDDL("token long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, count, total = [], 0, 0

        def report():
            token, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n >= REPORT_FROM
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], schema=arrow)

        for batch in batches:
            for part in chunks(batch, 0):
                for s in sets_of(part.column(0).to_pylist(), size):
                    held.append(s)
                    count += len(s)
                if count >= COUNT_AT_ONCE:
                    yield report()
                    held, total, count = [], total + count, 0
        yield report()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total + count])], schema=arrow)

    sums = documents.select(quoted(text).cast("binary").alias("t")).mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n"))
    all_of = F.max(F.when(F.col("token").isNull(), F.col("n")))
    sums = written(sums, "common")
    least = max(COMMON_FROM, (sums.agg(all_of).first()[0] or 0) * COMMON_SHARE)
    found = sums.where(F.col("token").isNotNull() & (F.col("n") >= least)).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def signatures(documents: DataFrame, text: str, keep: list[str], size: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """keep, n_shingles, class_id (equal for equal sets) and the prefix of the set, null where a task has just given it."""

    def factory():
        given: set[bytes] = set()

        def work(texts):
            n, ids, prefixes = [], [], []
            for s in sets_of(texts, size):
                n.append(len(s))
                ids.append(class_of(s))
                if ids[-1] in given:
                    prefixes.append(None)
                    continue
                if len(given) > 200_000:
                    given.clear()
                given.add(ids[-1])
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                prefixes.append(s[: prefix_length(len(s), num, den)].view(np.int64) if len(s) else None)
            return n, ids, prefixes

        return work

    return annotate(documents, text, keep, factory, "n_shingles long, class_id binary, prefix array<long>")


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Group:
    """The members of one group and the union of their tokens."""

    def __init__(self, ids: list, sets: list[np.ndarray], num: int, den: int):
        self.ids, self.sets, self.num, self.den = ids, sets, num, den
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]
        self.size = np.array([len(s) for s in sets])
        self.root = list(range(len(sets)))
        self.probes: dict[int, list[int]] = {}

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def linked(self, common, n: int, m):
        return common * self.den >= self.num * (n + m - common)

    def partners(self, s: np.ndarray, own: int | None = None):
        """A member of each class of linked members, among those before own (among all if it is None)."""
        left, right = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
        times = right - left
        if np.count_nonzero(times > (own is not None)) < need(len(s), self.num, self.den):
            return
        done = set()
        for root, few in list(self.probes.items()):
            for j in few:
                other = self.sets[j]
                at = np.minimum(np.searchsorted(other, s), len(other) - 1)
                if self.linked(int(np.count_nonzero(other[at] == s)), len(s), len(other)):
                    done.add(root)
                    yield j
                    break
        if len(done) == len(self.probes):
            return
        spread = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left, times)
        common = np.bincount(self.owner[spread], minlength=len(self.sets))
        for j in np.flatnonzero(self.linked(common, len(s), self.size)):
            root = self.find(int(j))
            if (own is None or j < own) and root not in done:
                done.add(root)
                yield int(j)

    def inner(self):
        """Pairs of members that together link all members that links connect."""
        for i, s in enumerate(self.sets):
            for j in list(self.partners(s, i)):
                a, b = self.find(i), self.find(j)
                if a != b:
                    self.root[a] = b
                    few = self.probes.pop(a, [])
                    self.probes[b] = [*few, *self.probes.get(b, [])][:4]
                    yield self.ids[i], self.ids[j]
            few = self.probes.setdefault(self.find(i), [])
            if len(few) < 4:
                few.append(i)

    def outer(self, c, s: np.ndarray):
        """Pairs of a query with a member of each connected class that it links with."""
        for j in list(self.partners(s)):
            yield c, self.ids[j]


def _edges(num: int, den: int):
    schema = T.StructType.fromDDL("u binary, v binary")
    arrow = to_arrow_schema(schema)

    def pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], arrow.field(i).type) for i in (0, 1)], schema=arrow)

    def run(batches):
        at, ids, sets, group = None, [], [], None
        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            values, ends = batch.column("set").values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column("set").offsets.to_numpy()
            for row, (g, role, c) in enumerate(zip(batch.column("g").to_pylist(), batch.column("role").to_pylist(), batch.column("c").to_pylist(), strict=True)):
                if g != at:
                    if group is None and len(ids) > 1:
                        out += Group(ids, sets, num, den).inner()
                    at, ids, sets, group = g, [], [], None
                s = values[ends[row] : ends[row + 1]]
                if role == 0:
                    if c not in ids[-1:]:
                        ids.append(c)
                        sets.append(s.copy())
                    continue
                if group is None:
                    group = Group(ids, sets, num, den)
                    out += group.inner()
                out += group.outer(c, s)
            if out:
                yield pairs(out)
                out = []
        if group is None and len(ids) > 1:
            out += Group(ids, sets, num, den).inner()
        if out:
            yield pairs(out)

    return run, schema


def links(documents: DataFrame, known: DataFrame, text: str, key: str, size: int, num: int, den: int) -> DataFrame:
    """(node, root) of every class that links connect with another one, root the least class of its component.

    known has the key, class_id, n_shingles and prefix of every document that can link.
    """
    spark = documents.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least_overlap = F.floor(F.ceil(F.col("n") * num / den) / 32).cast("long") + 1  # of a partner, which has that size at least
    # Where only candidates are looked for, a class goes by 64 bits of its id: classes that share them are sent together.
    tokens = known.select(F.xxhash64("class_id").alias("c"), F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("token"))
    tokens = tokens.repartition(parallel, "token").dropDuplicates(["token", "c"])
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(tokens.join(shared, "token"), "shared")
    # The group of a class: its most shared prefix token, by which near copies meet, and its size in steps of the similarity.
    base = shared.groupBy("c").agg(F.min("n").alias("n"), F.max(F.struct("df", F.xxhash64("token").alias("h"))).alias("h"), F.count("*").alias("k")).where(F.col("k") >= least_overlap)
    base = base.withColumn("h", F.col("h.h")).withColumn("band", F.floor(F.log(F.col("n")) / math.log(den / num)) if num < den else F.col("n"))
    base = written(base.select("c", "n", F.xxhash64("h", "band").alias("h")), "base")
    large = base.groupBy("h").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("parts")).where("parts > 1")
    large = F.broadcast(large) if large.count() <= LISTED_GROUPS else large
    members = base.join(large, "h", "left").select("c", "n", F.xxhash64("h", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1)))).alias("g"))
    members = written(members, "members")
    groups = members.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"), F.min_by("c", F.xxhash64("c")).alias("l0"), F.max_by("c", F.xxhash64("c")).alias("l1"))
    groups = written(groups, "groups")
    leaders = groups.select(F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("c")).distinct()
    # Tokens that the same groups have count together: such a list of groups is known by their number and two sums of hashes.
    held = shared.select("c", "token").join(members, "c")
    told = held.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")).where("m > 1")
    firsts = told.groupBy("m", "x", "y").agg(F.min("token").alias("list"))
    lists = written(told.join(firsts, ["m", "x", "y"]).select("token", "list"), "lists")
    met = written(held.join(lists, "token").groupBy("c", "list").agg(F.min("n").alias("n"), F.min("g").alias("g"), F.count("*").alias("k")), "met")
    listed = held.join(lists.where("token = list"), "token").select("list", "g").distinct().join(groups.select("g", "least", "most"), "g")
    listed = written(listed.select("list", F.col("g").alias("to"), "least", "most"), "listed")
    fits = (F.col("to") < F.col("g")) & (F.col("n") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("n") * den)

    def routed(met, listed, more=None):
        found = met.join(listed, "list").where(fits if more is None else fits & more).groupBy("c", "to").agg(F.min("n").alias("n"), F.sum("k").alias("k"))
        return found.where(F.col("k") >= least_overlap).select("c", F.col("to").alias("g"), "n", F.lit(1).alias("role"))

    def opened(own, queries, name):
        """Pairs of classes that groups find among their own members and the queries sent to them."""
        send = written(own.unionByName(queries), f"sent{name}")
        reps = known.groupBy("class_id").agg(F.min(quoted(key)).alias("rep")).withColumn("c", F.xxhash64("class_id"))
        to = send.join(reps, "c").select("rep", F.col("class_id").alias("c"), "g", "role")
        texts = documents.select(quoted(key).alias("k"), quoted(text).cast("binary").alias("t"))
        tasks = max(parallel, -(-(send.agg(F.sum("n")).first()[0] or 0) // TASK_TOKENS))
        # A class that goes to several groups is a row for each: no list of them is gathered.
        sets = texts.join(to, F.col("k") == F.col("rep")).select("t", "c", "g", "role").mapInArrow(dealt, schema)
        run, out = _edges(num, den)
        pairs = sets.repartition(tasks, "g").sortWithinPartitions("g", "role", "c").mapInArrow(run, out)
        return written(pairs, f"pairs{name}")

    schema = T.StructType.fromDDL("g long, role int, c binary, set array<long>")
    arrow = to_arrow_schema(schema)

    def dealt(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                rows, last, s = ([], [], [], []), None, None
                for t, c, g, role in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if last != (c, t):
                        s, last = sets_of([t], size)[0], (c, t)
                    if class_of(s) == c:
                        for column, value in zip(rows, (g, role, c, s.view(np.int64)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, arrow.field(i).type) for i, v in enumerate(rows)], schema=arrow)

    own = members.select("c", "g", "n", F.lit(0).alias("role"))
    first = routed(met.join(leaders, "c", "left_semi"), listed)
    alone = groups.where("members = 1").select("g").join(first.select("g").distinct(), "g", "left_anti")
    pairs = opened(own.join(alone, "g", "left_anti"), first, 1)
    stars = connected(pairs)
    # The component that a group or a list of groups is all of, if it is one.
    roots = stars.select(F.xxhash64("node").alias("c"), F.xxhash64("root").alias("root"))
    whole = members.join(roots, "c", "left").select("c", "g", F.coalesce("root", "c").alias("root"))
    of_group = whole.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    of_list = listed.join(of_group.withColumnRenamed("g", "to"), "to").groupBy("list").agg(F.min("low").alias("llow"), F.max("high").alias("lhigh"))
    # Lists that are all of one component need nothing more; most hot ones, which families share, are such lists.
    mixed = written(of_list.where("llow <> lhigh").select("list"), "mixed")
    mixed = F.broadcast(mixed) if mixed.count() <= LISTED_GROUPS else mixed
    open_to = listed.join(mixed, "list", "left_semi").join(of_group.withColumnRenamed("g", "to"), "to")
    other = met.join(mixed, "list", "left_semi").join(whole.select("c", "root"), "c")
    second = routed(other, open_to, (F.col("low") != F.col("high")) | (F.col("low") != F.col("root")))
    second = written(second.join(leaders, "c", "left_anti"), "second")
    if second.isEmpty():
        return stars
    asked = own.join(second.select("g").distinct(), "g", "left_semi")
    pairs = opened(asked, second, 2)
    return connected(pairs.unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), root the least node that is reached: alternating star contraction.

    Each round is two joins on a node's least neighbour and is written, so that no plan grows with the rounds, of which
    there are about as many as the logarithm of the longest path.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def components(documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each document: key, n_shingles, component_id.

    Words are runs other than ASCII white space, A-Z as a-z; a set is the distinct shingles of size words, of fewer words
    the whole sequence. Two documents link if den * intersection >= num * union; component_id is the least key that links
    reach, the document's own included. Documents without words, or with a null key, link with nothing (a null key stays
    null). Repeated keys link as the texts they stand for, and rows come back as often as they were given. Other columns
    are not read.
    """
    rows = documents.select(quoted(key).alias(key), quoted(text).alias(text))
    common = common_shingles(rows, text, size)
    known = written(signatures(rows, text, [key], size, num, den, common), "signatures")
    linked = known.where((F.col("n_shingles") > 0) & quoted(key).isNotNull())
    stars = links(rows, linked, text, key, size, num, den)
    ids = linked.groupBy("class_id").agg(F.min(quoted(key)).alias("rep"))
    ids = ids.join(stars, F.col("class_id") == F.col("node"), "left").select("class_id", "rep", F.coalesce("root", "class_id").alias("root"))
    least = ids.groupBy("root").agg(F.min("rep").alias("least"))
    ids = ids.join(least, "root").select("class_id", "least")
    of_class = F.when((F.col("n_shingles") > 0) & quoted(key).isNotNull(), F.col("class_id"))
    return known.select(quoted(key).alias(key), "n_shingles", of_class.alias("class_id")).join(ids, "class_id", "left").select(key, "n_shingles", F.coalesce("least", quoted(key)).alias("component_id"))
