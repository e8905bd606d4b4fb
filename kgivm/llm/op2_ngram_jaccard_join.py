"""N-gram Jaccard join with signature trees.

1. Every text becomes its set of word-shingle fingerprints. A node is a distinct
   set, named by a fingerprint of its own, so equal sets fall together.
2. Blocking without loss: two sets that link differ in at most d shingles, d
   following from the threshold and the sizes, so if the fingerprint space is cut
   into more than d ranges, some hold the same shingles in both. Sets share the
   digests of their ranges per size class; a set belongs to its own class and the
   next, so linked sets have one class in common. Whoever shares a digest is in
   one family.
   Shingles of passages that many documents share would join families that have
   little in common. So the most frequent ones (``COMMON`` at most, counted over
   all documents) are left out of the ranges first. That loses nothing: leaving
   the same shingles out of both sets makes them differ in no more places. Only a
   set that keeps too few shingles to be sure of a full common range sends the
   digests of its whole ranges as well, and of two linked sets either one is sure
   or both send them.
3. In a family, documents are leaves of a signature tree: nodes hold the OR of
   token bitmaps, size ranges and the largest surplus of tokens over bits. The
   tree is traversed against itself; a pair of nodes is dropped when its largest
   possible overlap is below what the threshold needs. What is left is compared
   exactly. Pairs already connected need no comparison, as only components are
   asked for.
4. A large family is cut by size classes, two neighbours to a unit; a unit that
   is still too large is dealt out in chunks with a few common pivots, and then
   only documents outside its largest component meet the other chunks.

Texts move only for members of families of two and more: a bitmap of fixed size
(``MEMBER_BITS``) over their ids filters the table before it is shuffled.

Texts without words have no set: 0 shingles, a component of their own. Null ids
get a null component and link with nothing. Rows that share an id are one node
that has the links of each. Extra columns are ignored by ``jaccard_components``
and kept by ``keep_first``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgivm.llm import scratch
from kgivm.llm.components import components, forest
from kgivm.llm.kernels import BYTE, LOWER, SPACE, Prints, U, chunks, mix, runs

LEAF = FAN = 16
CHUNK_DOCS, CHUNK_SHINGLES = 1024, 1 << 20
#: Shingles are counted in 2**34 buckets, of which the COMMON most frequent with COMMON_DOCS documents or more are left out at first. Any choice gives the same result.
BUCKET = U(30)
COMMON, COMMON_DOCS = 1 << 18, 32
MEMBER_BITS = 1 << 26
#: Shingles that a task works on at once.
SET_RUN = 1 << 19


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct fingerprints of its k-word shingles; of the whole sequence if it has fewer words."""
    start, end = runs(~SPACE[data], at)
    bounds = np.searchsorted(start, at)
    words = Prints(BYTE[LOWER[data]]).of(start, end)
    prints = Prints(words)
    grams = prints.grams(k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            out.append(g[keep])
        else:
            out.append(prints.of(np.array([a]), np.array([b])) if b > a else grams[:0])
    return out


class Ladder:
    """Size classes; for each the number of ranges and of differences that two linked sets of the class may have."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges, self.ranges, self.apart = [1], [], []

    def grow(self, label: int) -> None:
        while len(self.ranges) <= label:
            i = len(self.ranges)
            self.edges.append(self.edges[i] * 100 // self.percent + 1)
            apart = 2 * (self.edges[i + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            # a quarter more than needed, as a few ranges are empty
            self.ranges.append(-(-5 * (apart + 1) // 4))
            self.apart.append(apart)

    def own(self, n: int) -> int:
        """The class of size n (>= 1)."""
        while self.edges[-1] <= n:
            self.grow(len(self.ranges))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def digests(self, s: np.ndarray, label: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the ranges that hold shingles, and tags of the empty ones."""
        m = self.ranges[label]
        sums = np.zeros(len(s) + 1, U)
        np.cumsum(mix(s), out=sums[1:])
        # range of a fingerprint: its upper half times m, shifted; ascending with it
        cut = np.searchsorted((s >> U(32)) * U(m) >> U(32), np.arange(m + 1, dtype=U))
        full = cut[1:] > cut[:-1]
        tag = mix(np.arange(m, dtype=U) + U(label << 32) + U(salt))
        return mix((sums[cut[1:]] - sums[cut[:-1]]) ^ tag)[full], tag[~full]

    def keys(self, s: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        """Digests of a set's ranges for its class and the next one. ``rare``: what is left of it without common shingles."""
        own = self.own(len(s))
        self.grow(own + 1)
        out = [s[:0]]
        for label in (own, own + 1):
            sure = self.ranges[label] - self.apart[label]  # so many ranges agree at least
            if not self.apart[label]:
                continue  # links of this class are equal sets
            got, empty = self.digests(s if rare is None else rare, label, 1)
            out.append(got)
            if len(empty) < sure:
                continue
            got, empty = self.digests(s, label, 2)
            out.append(got)
            if len(empty) >= sure:  # a partner may share nothing but empty ranges
                out.append(mix(empty ^ U(0xE317)))
        return np.concatenate(out)


def set_print(s: np.ndarray) -> np.uint64:
    """The name of a set."""
    return mix(np.add.reduce(mix(s), dtype=U)[None] + U(len(s)))[0]


def _sets(src: DataFrame, k: int) -> DataFrame:
    """doc, n, set (its fingerprint; null if empty) of every row."""
    kind = src.schema["doc"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                got = shingles(data, at, k)
                n = np.array([len(s) for s in got], np.int64)
                whole = np.array([set_print(s) if len(s) else 0 for s in got], U)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(whole.view(np.int64), mask=n == 0)], ["doc", "n", "set"])

    return src.mapInArrow(digest, f"doc {kind}, n long, set long")


def _distinct(column: pa.Array, k: int, most: int):
    """The distinct sets of a batch and their names, in runs of at most ``most`` shingles or one set."""
    seen: set[int] = set()
    sets, names, total = [], [], 0
    for _, _, data, at in chunks(column):
        for s in shingles(data, at, k):
            if not len(s) or (name := int(set_print(s))) in seen:
                continue
            seen.add(name)
            sets.append(s)
            names.append(name)
            total += len(s)
            if total >= most:
                yield sets, names
                sets, names, total = [], [], 0
    if sets:
        yield sets, names


def common_buckets(src: DataFrame, k: int) -> np.ndarray:
    """The most frequent buckets of shingles, ascending: COMMON at most, of COMMON_DOCS sets or more.

    Every shingle of every text is counted: batches send their buckets as sorted
    blocks of three bytes each, by slices of the bucket space, and a slice is
    counted in an array of fixed size.
    """

    def send(batches):
        for batch in batches:
            for sets, _ in _distinct(batch.column(0), k, SET_RUN):
                bucket = np.sort(np.concatenate(sets) >> BUCKET)
                cut = np.searchsorted(bucket, np.arange(4097, dtype=U) << U(22))
                low = (bucket & U((1 << 22) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([low[3 * cut[i] : 3 * cut[i + 1]] for i in used], pa.binary())], ["slice", "low"])

    def count(batches):
        now, sums = None, np.zeros(1 << 22, np.int64)

        def found():
            low = np.flatnonzero(sums >= COMMON_DOCS)
            return pa.RecordBatch.from_arrays([pa.array(low + (now << 22)), pa.array(sums[low])], ["bucket", "docs"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != now:
                    if now is not None:
                        yield found()
                    now = name
                    sums[:] = 0
                wide = np.zeros((len(raw.as_buffer()) // 3, 4), np.uint8)
                wide[:, :3] = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 3)
                at, times = np.unique(wide.view("<u4")[:, 0], return_counts=True)
                sums[at] += times
        if now is not None:
            yield found()

    sent = src.select("text").mapInArrow(send, "slice int, low binary").repartition("slice").sortWithinPartitions("slice")
    found = sent.mapInArrow(count, "bucket long, docs long").orderBy(F.desc("docs"), "bucket").limit(COMMON)
    return np.sort(found.toArrow()["bucket"].to_numpy().astype(U))


def _keys(src: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """key, set: sets with a common key belong to one family. Inside a run of texts, a key is sent once."""

    def emit(batches):
        ladder = Ladder(percent)
        for batch in batches:
            for sets, names in _distinct(batch.column(0), k, SET_RUN):
                flat = np.concatenate(sets)
                bucket = flat >> BUCKET
                at = np.minimum(np.searchsorted(common, bucket), max(0, len(common) - 1))
                rare = common[at] != bucket if len(common) else np.ones(len(flat), bool)
                ends = np.cumsum([0, *map(len, sets)])
                got = [ladder.keys(s, s[rare[a:b]]) for s, a, b in zip(sets, ends[:-1], ends[1:])]
                key, of = np.concatenate(got), np.repeat(np.array(names, U), [len(g) for g in got])
                if not len(key):
                    continue
                found, first, back = np.unique(key, return_index=True, return_inverse=True)
                lead = of[first]
                star = np.unique(np.stack([lead[back], of], 1)[lead[back] != of], axis=0)
                # a set that has met a leader here meets it again under one key
                hub = mix(star[:, 0] ^ mix(found[:1])) if len(star) else found[:0]
                key = np.concatenate([found, hub, hub])
                of = np.concatenate([lead, star[:, 0], star[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(of.view(np.int64))], ["key", "set"])

    return src.select("text").mapInArrow(emit, "key long, set long")


class Tree:
    """A signature tree over the bitmaps (packed, rows of whole 64-bit words) and sizes of some sets, smallest first."""

    def __init__(self, maps: np.ndarray, n: np.ndarray):
        maps = np.ascontiguousarray(maps).view(np.uint64)
        extra = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, extra)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(maps), LEAF if len(self.levels) == 1 else FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs (a x b) of nodes may hold linked documents."""
        maps, low, high, extra = self.levels[level]
        ok = (100 * high[a][:, None] >= percent * low[b]) & (100 * high[b] >= percent * low[a][:, None])
        overlap = np.bitwise_count(maps[a][:, None] & maps[b]).sum(2, dtype=np.int64) + np.minimum(extra[a][:, None], extra[b])
        overlap = np.minimum(overlap, np.minimum(high[a][:, None], high[b]))
        return ok & ((100 + percent) * overlap >= percent * (low[a][:, None] + low[b]))

    def children(self, level: int, node: int) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        return np.arange(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))


def bits_for(n: int, per_token: int) -> int:
    bits = 64
    while bits < per_token * n and bits < 1 << 16:
        bits *= 2
    return bits


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Packed bitmap of a set: a token's bit is given by its upper bits, so halving the bits joins neighbours."""
    row = np.zeros(bits, bool)
    row[(s >> U(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(row)


def open_pairs(tree: Tree, side: np.ndarray, root: np.ndarray, percent: int):
    """Pairs of documents that the dual traversal of a tree leaves. ``side``: 1 compares with all, 0 with 1 only. ``root`` (components) may change meanwhile."""
    asks = [side]
    for level in range(1, len(tree.levels)):
        asks.append(np.maximum.reduceat(asks[-1], np.arange(0, len(asks[-1]), LEAF if level == 1 else FAN)))
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        if level == 0:
            continue
        a, b = tree.children(level, x), tree.children(level, y)
        open_ = (asks[level - 1][a][:, None] | asks[level - 1][b]) > 0
        if x == y:
            open_ &= a[:, None] <= b if level > 1 else a[:, None] < b
        if level == 1:
            open_ &= root[a][:, None] != root[b]
        if not open_.any():
            continue
        ok = open_ & tree.possible(level - 1, a, b, percent)
        if level > 1:
            stack += [(level - 1, int(a[i]), int(b[j])) for i, j in np.argwhere(ok)]
            continue
        for i, j in np.argwhere(ok):
            if root[a[i]] != root[b[j]]:
                yield a[i], b[j]


def link(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components among some sets."""
    order = np.lexsort([[int(s[0]) for s in sets], [len(s) for s in sets]])
    sets, side, root = [sets[i] for i in order], side[order], root[order].copy()
    bits = bits_for(len(sets[-1]), 8)
    tree, found = Tree(np.stack([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets])), []
    for p, q in open_pairs(tree, side, root, percent):
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
            found.append((int(order[p]), int(order[q])))
            root[root == root[q]] = root[p]
    return found


def _read(batch: pa.RecordBatch, k: int, name: int, text: int):
    """Row number and shingles of the rows whose text is the set that they name."""
    names = batch.column(name).to_numpy().astype(np.int64).view(U)
    for lo, _, data, at in chunks(batch.column(text)):
        for i, s in enumerate(shingles(data, at, k), lo):
            if len(s) and set_print(s) == names[i]:
                yield i, s


def _signatures(rows: DataFrame, k: int) -> DataFrame:
    """set, n, bits (4 per token, rounded up to a power of two). ``rows``: set, text."""

    def sign(batches):
        for batch in batches:
            got = list(_read(batch, k, 0, 1))
            maps = [bitmap(s, bits_for(len(s), 4)).tobytes() for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.array([len(s) for _, s in got], pa.int64()), pa.array(maps, pa.binary())], ["set", "n", "bits"])

    return rows.select("set", "text").mapInArrow(sign, "set long, n long, bits binary").dropDuplicates(["set"])


def _groups(batches, width: int):
    """The rows of each group, from batches sorted by group: lists by column, without the group's name."""
    now, group = None, [[] for _ in range(width)]
    for names, *columns in batches:
        for name, *values in zip(names, *columns):
            if name != now:
                if len(group[0]) > 1:
                    yield group
                now, group = name, [[] for _ in range(width)]
            for part, value in zip(group, values):
                part.append(value)
    if len(group[0]) > 1:
        yield group


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets inside groups that the tree over their signatures leaves. ``rows``: grp, set, side, root, n, bits."""
    sent = rows.repartition("grp").sortWithinPartitions("grp")

    def run(batches):
        for names, side, root, n, bits in _groups(([batch.column(i).to_pylist() for i in range(6)] for batch in batches), 5):
            order = np.argsort(np.array(n), kind="stable")
            width = min(map(len, bits))
            maps = []
            for i in order:
                row = np.frombuffer(bits[i], np.uint8)
                if len(row) > width:  # halve until the lengths agree
                    row = np.packbits(np.unpackbits(row).reshape(width * 8, -1).any(1))
                maps.append(row)
            tree = Tree(np.stack(maps), np.array(n)[order])
            found = [(names[order[p]], names[order[q]]) for p, q in open_pairs(tree, np.array(side)[order], np.array(root)[order], percent) if names[order[p]] != names[order[q]]]
            if found:
                yield _pairs(found)

    return sent.select("grp", "set", "side", "root", "n", "bits").mapInArrow(run, "a long, b long")


def _linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between sets inside groups. ``rows``: grp (string), set, side, root, text, all rows of a group together."""
    sent = rows.repartition("grp").sortWithinPartitions("grp", "set")

    def columns(batches):
        for batch in batches:
            got = list(_read(batch, k, 1, 4))
            kept = batch.select([0, 1, 2, 3]).take(pa.array([i for i, _ in got], pa.int64()))
            yield [*(c.to_pylist() for c in kept.columns), [s for _, s in got]]

    def run(batches):
        for names, side, root, sets in _groups(columns(batches), 4):
            found = [(names[i], names[j]) for i, j in link(sets, np.array(side), np.array(root), percent) if names[i] != names[j]]
            if found:
                yield _pairs(found)

    return sent.select("grp", "set", "side", "root", "text").mapInArrow(run, "a long, b long")


def _chunks(docs, total):
    return F.greatest(F.ceil(docs / CHUNK_DOCS), F.ceil(total / CHUNK_SHINGLES))


def _units(members: DataFrame, percent: int) -> DataFrame:
    """Families too large for one task become units of two neighbouring size classes: linked sets lie in one class or in neighbours, so each is in its own unit and in that of the class below."""
    total = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    large = total.where(_chunks(F.col("docs"), F.col("total")) > 1).select("family", F.lit(True).alias("large"))
    most = members.agg(F.max("n")).first()[0] or 1
    ladder = Ladder(percent)
    ladder.own(most)
    own = F.size(F.filter(F.array(*(F.lit(e) for e in ladder.edges)), lambda e: e <= F.col("n"))) - 1
    rows = members.join(large, "family", "left")
    unit = F.explode(F.when(F.col("large"), F.array(own, own - 1)).otherwise(F.array(F.lit(-2))))
    return scratch.saved(rows.withColumn("unit", unit).select(F.concat_ws("/", F.col("family").cast("string"), "unit").alias("family"), "set", "rep", "n"))


def _only_members(src: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``src`` whose ids may be those of members: a bitmap of MEMBER_BITS bits, in blocks of 4 KB, is all that is sent to the tasks."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS)) + 1
    # whole blocks are built where their spots meet: half-built ones are as large as whole ones
    spots = members.select(spot("rep").alias("spot")).withColumn("block", F.expr("bitmap_bucket_number(spot)")).repartition("block")
    marked = spots.groupBy("block").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits"))
    rows = src.withColumn("spot", spot("doc")).withColumn("block", F.expr("bitmap_bucket_number(spot)")).join(F.broadcast(marked), "block")
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(spot) div 8 as int) + 1, 1)), 16, 10) as int)")
    return rows.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(spot) % 8 as int))")) != 0).select("doc", "text")


def _families(src: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """family, set, rep, n of the sets that share a key with another one."""
    spark = src.sparkSession
    keys = _keys(src, k, percent, common_buckets(src, k))
    lead = F.min("set").over(Window.partitionBy("key"))
    led = scratch.saved(forest(keys.select("set", lead.alias("lead")).where("set <> lead").distinct(), "set", "lead"))
    found = components(led, "a", "b").select(F.col("node").alias("set"), F.col("component").alias("family"))
    members = scratch.saved(found.join(reps, "set"))
    scratch.remove(spark, led)
    return members


def _links(src: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between sets that connect all sets that links connect."""
    spark = src.sparkSession
    members = _units(members, percent)
    odd = lambda salt: F.xxhash64("set", F.lit(salt))
    sizes = members.groupBy("family").agg(
        F.count("*").alias("docs"), F.sum("n").alias("total"),
        F.array_distinct(F.array(F.min("set"), *(F.min_by("set", odd(i)) for i in range(3)), F.min_by("set", "n"), F.max_by("set", "n"))).alias("pivots"),
    ).where("docs > 1")
    sizes = scratch.saved(sizes.withColumn("chunks", _chunks(F.col("docs"), F.col("total"))))
    dealt = scratch.saved(members.join(sizes.select("family", "chunks"), "family").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks"))))
    scratch.remove(spark, members)
    # ids of members and the bitmap over them are of all families, so each text is found by its set's one id
    named = dealt.select("set", "rep").distinct()
    held = named.join(_only_members(src, named).hint("merge"), named["rep"] == F.col("doc")).select("set", "text")

    many = sizes.where("chunks > 1")
    pivots = many.select("family", "chunks", F.explode("pivots").alias("set"))
    pivots = pivots.select("family", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    first = dealt.select("family", "set", "chunk").unionByName(pivots).distinct()
    first = first.select(F.concat_ws(":", "family", "chunk").alias("grp"), "set", F.lit(1).alias("side"), F.col("set").alias("root"))
    links = scratch.saved(_linked(first.join(held, "set"), k, percent))
    if many.isEmpty():
        return links

    so_far = components(links, "a", "b")
    placed = dealt.join(many.select("family"), "family", "left_semi").join(so_far.withColumnRenamed("node", "set"), "set", "left")
    placed = scratch.saved(placed.withColumn("root", F.coalesce("component", "set")).drop("component"))
    giant = placed.groupBy("family", "root").agg(F.count("*").alias("m")).groupBy("family").agg(F.max_by("root", F.struct("m", "root")).alias("giant"))
    rest = scratch.saved(placed.join(giant, "family").where("root <> giant").drop("giant"))
    if rest.isEmpty():
        return links
    size = rest.groupBy("family").agg(_chunks(F.count("*"), F.sum("n")).alias("parts"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    lone = rest.join(size, "family").withColumn("part", F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts")))
    lone = lone.select("family", "set", "root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"))
    others = placed.join(size, "family").select("family", "set", "root", part.alias("part"), "chunk", F.lit(0).alias("side"))
    second = lone.unionByName(others).select(F.concat_ws(":", "family", "part", "chunk").alias("grp"), "set", "side", "root")
    # signatures meet, a fraction of the texts' size; texts only of the pairs that they leave
    signed = scratch.saved(_signatures(placed.select("set").distinct().join(held, "set"), k))
    pairs = scratch.saved(_candidates(second.join(signed.hint("merge"), "set"), percent).distinct())
    scratch.remove(spark, signed)
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK_DOCS).alias("shares"))
    pairs = pairs.join(share, "a").withColumn("grp", F.concat_ws(":", "a", F.pmod(F.xxhash64("b"), F.col("shares"))))
    third = pairs.select("grp", F.col("a").alias("set"), F.lit(1).alias("side")).unionByName(pairs.select("grp", F.col("b").alias("set"), F.lit(0).alias("side"))).distinct()
    return links.unionByName(scratch.saved(_linked(third.withColumn("root", F.col("set")).join(held, "set"), k, percent)))


def jaccard_components(docs: DataFrame, *, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id of every row: components of the graph whose links are pairs with Jaccard similarity of percent / 100 or more."""
    src = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    sets = scratch.saved(_sets(src, k))
    named = sets.where("doc IS NOT NULL AND set IS NOT NULL")
    reps = scratch.saved(named.groupBy("set").agg(F.min("doc").alias("rep"), F.max("n").alias("n")))
    src = src.where("doc IS NOT NULL")
    links = _links(src, _families(src, reps, k, percent), k, percent)

    of = reps.select("set", "rep")
    edges = links.join(of.select(F.col("set").alias("a"), F.col("rep").alias("x")), "a").join(of.select(F.col("set").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    # rows that share an id: the id is a node beside those of their sets
    shared = named.groupBy("doc").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("doc")
    twins = named.join(shared, "doc").select("doc", "set").distinct().join(of, "set").select(F.col("rep").alias("x"), F.col("doc").alias("y"))
    final = components(edges.unionByName(twins), "x", "y").withColumnRenamed("node", "rep")
    by_set = reps.join(final, "rep", "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    got = sets.join(by_set, "set", "left")
    own = F.when(F.col("set").isNull(), F.col("doc")).when(F.col("doc").isNotNull(), F.col("component_id"))
    return got.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component (rows without id stay)."""
    got = jaccard_components(docs, k=k, percent=percent, key=key, text=text)
    gone = got.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[key] == gone["_gone"], "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
