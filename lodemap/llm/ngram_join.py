"""N-gram Jaccard self-join: universe partition by size band, segment subsets and one-deletion neighbourhoods, exact checks.

Two sets of a and b members with a Jaccard similarity of at least p % differ in at most (a + b)(100 - p) / (100 + p) members.
The universe of shingles is dealt by hash into segments, as many as make it certain that two such sets agree in some of
them: their subsets inside a segment are equal, or equal but for one member where a segment also has its one-deletion
neighbourhood. Sets that share such a key are candidates, and every comparison is exact. Equal sets are one node from the
start.

The sets of a key are never all compared with each other. One of them, the pivot, is compared with the others; they are its
star. What they have in common with the pivot can't tell them apart, so the next index holds their differences from it: two
similar sets of a star, not both linked to the pivot, share a difference (``_prefixes``). A group of near copies of one
text, or of texts with one passage, thus falls apart into small groups, in as many rows as the differences are.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, hinted, mapped, rest, sampled, utf8, written

#: Members of a group of differences, at most, that are compared directly; of a larger group those outside its largest component,
#: at most, that are compared with all. Sizes, differences and places leave few of these pairs. Other groups get a pivot.
SMALL_GROUP, FEW_OTHERS = 128, 64
_DIRECT = f"c <= {SMALL_GROUP} or others <= {FEW_OTHERS}"
#: Members of a key that are compared with its later ones in one round, when every link is wanted.
CENTERS = 32
#: Distinct sets, about, from which common keys are told, keys that are treated as common, at most, and the sets of the sample
#: that hold one of these at least. Other keys meet in one task each.
HOT_SETS, HOT_KEYS, HOT_TIMES = 5_000, 20_000, 10
#: Set ids that a task remembers, in order not to emit the keys of a copy again.
REMEMBERED = 200_000
#: Sets of the sample that segments are allotted by.
ALLOT_SETS = 300
#: Rows of edges or roots that make a partition of their own.
ROWS_A_PART = 200_000
#: Rows of keys that one wrong candidate costs as much as, when segments are allotted.
CANDIDATE_COST = 8.0
#: Longs of a set's sketch: the parities of its members' numbers in 64 times as many buckets.
SKETCH = 16
#: Pairs of two components that are compared at first, and how many times more in each further round.
FIRST_PAIRS, MORE_PAIRS = 4, 64

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)

# --- shingles ----------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _B
    return x ^ (x >> _U(29))


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    cut = [t.lower().split() for t in texts]
    distinct = list(set(chain.from_iterable(cut)))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))
    sizes = [len(w) for w in cut]
    words = table[np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, sum(sizes))]
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):  # rolled[i] takes words i to i + k - 1, across texts where they end; those are not read
        rolled[: n - j] = _mixed(rolled[: n - j] * _A + words[j:] + _C)
    out, at = [], 0
    for size in sizes:
        if size >= k:
            out.append(np.unique(rolled[at : at + size - k + 1]))
        elif size:
            short = np.array([size], np.uint64)
            for w in words[at : at + size]:
                short = _mixed(short * _A + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def set_id(members: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), seed) >> 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(members: np.ndarray) -> np.ndarray:
    """Whether an odd number of members is in each of some buckets, as bits. A bit in which two sets' sketches differ stands for
    a member that only one of them has, so they differ in as many members at least."""
    bucket = ((members.view(np.uint64) * _A) >> _U(32)) % _U(64 * SKETCH)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# --- segments ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` of the smaller of two sets, and the segments for such pairs.

    The first ``near`` segments have one-deletion neighbourhoods: a pair that shares no key there differs in two members or
    more; in each of the ``exact`` ones it differs in one or more. The numbers are such that a similar pair, apart in
    ``apart`` members at most, shares more than ``slack`` keys. So every set may leave out its ``slack`` most common keys: of
    the keys that a pair shares, the least common one has ``slack`` others before it in both sets' orders, and both keep it.
    """

    number: int
    low: int
    high: int
    apart: int
    near: int
    exact: int
    slack: int


def _poisson_above(mean: float, most: int) -> float:
    """The probability that a Poisson number exceeds ``most``."""
    if mean > 200 or most > 4 * mean + 20:  # as a normal number
        return 0.5 * math.erfc((most + 0.5 - mean) / math.sqrt(2 * max(mean, 1e-9)))
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def _edges(percent: int, largest: int) -> list[tuple[int, int]]:
    """The bands' least and largest sizes of the smaller set of a pair, up to a band that holds ``largest``."""
    out, low = [], 1
    while not out or low <= largest:
        high = low * 10_000 // (percent * percent)
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(maxsize=8)
def bands(percent: int, docs: int, largest: int = 1 << 33) -> tuple[Band, ...]:
    """Bands over all sizes. Each gets the allotment of least cost: rows of keys, plus the candidates that empty segments are
    expected to make among ``docs`` documents."""
    out = []
    for number, (low, high) in enumerate(_edges(percent, largest)):
        options = []
        for band in _allotments(percent, number, low, high):
            segments = band.near + band.exact
            empty = math.exp(-low / segments) if segments else 0.0
            wrong = docs * empty * (band.near + min(band.exact, 1) * _poisson_above(band.exact * empty, band.slack))
            options.append((segments + low * band.near / max(segments, 1) + CANDIDATE_COST * wrong, band))
        out.append(min(options, key=lambda x: x[0])[1])
    return tuple(out)


def _allotments(percent: int, number: int, low: int, high: int) -> Iterator[Band]:
    """Every allotment of a band that is exact: by the number of segments with one-deletion neighbourhoods."""
    apart = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    for near in range(min((apart + 2) // 2, 8) + 1):
        exact = max(0, apart + 1 - 2 * near)
        slack = max(1, exact // 8) if exact else 0
        yield Band(number, low, high, apart, near, exact + (2 * slack if near else slack), slack)  # a near segment's two may be one key


def allotted(percent: int, docs: int, sample: list[np.ndarray], largest: int = 1 << 33) -> tuple[Band, ...]:
    """``bands``, and where the sample has sets of a band, the allotment that costs least by what it shows: rows of keys a set,
    and the candidates that its keys make, as many times as there are more documents than sets in the sample."""
    table = list(bands(percent, docs, largest))
    sizes = np.array([len(s) for s in sample])
    for band in table:
        own = [sample[i] for i in np.flatnonzero((sizes >= band.low) & (sizes * percent <= 100 * band.high))]
        if len(own) < 8 or not band.apart:
            continue
        options = []
        for option in _allotments(percent, band.number, band.low, band.high):
            keys = [segment_keys(s, option) for s in own]
            _, times = np.unique(np.concatenate(keys), return_counts=True)
            common = np.sort(times)[: len(times) - option.slack]  # about what sets leave out
            wrong = float((common * (common - 1)).sum()) / len(own) * docs / len(sample)
            options.append((sum(map(len, keys)) / len(own) + CANDIDATE_COST * wrong, option))
        table[band.number] = min(options, key=lambda x: x[0])[1]
    return tuple(table)


def band_numbers(size: int, table: tuple[Band, ...], percent: int) -> list[int]:
    """The bands in which a set of this size can be one of a pair: its own, and before it the one that its partner may be in."""
    own = bisect_left(table, size, key=lambda b: b.high)
    return [i for i in (own, own - 1) if i >= 0 and (i == own or size * percent <= 100 * table[i].high)]


def segment_keys(members: np.ndarray, band: Band) -> np.ndarray:
    """The keys of one set in one band: a hash of the members of each segment, and of those of the near ones but one."""
    if not band.apart:  # only equal sets are so similar
        return np.zeros(0, np.int64)
    segments = band.near + band.exact
    place = ((members * _C) >> _U(33)) % _U(segments)
    place = place.astype(np.int64)
    sums = np.zeros(segments, np.uint64)
    ordered = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.diff(place[ordered], prepend=-1))
    sums[place[ordered[starts]]] = np.add.reduceat(members[ordered], starts)  # modulo 2**64
    salt = _mixed(np.array([band.number + 1], np.uint64) * _A)
    keys = [_mixed(_mixed(sums ^ salt) + np.arange(segments, dtype=np.uint64) * _A)]
    if band.near:
        inside = place < band.near
        keys.append(_mixed(_mixed((sums[place[inside]] - members[inside]) ^ salt) + place[inside].astype(np.uint64) * _A))
    return _mixed(np.concatenate(keys) ^ salt).astype(np.int64)


# --- the join ----------------------------------------------------------------------------------------------------------


def _nodes(docs: DataFrame, key: str, text: str, k: int, percent: int, table: tuple[Band, ...], seed: int) -> DataFrame:
    """__key, body (a hash of the text), n, node (an even id of the set, null when empty), check (another one), and the keys of
    the set with their number in its own band and the slack of both bands. Of the copies of a set that a task sees in a row the
    first one has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = np.zeros(0, np.int64)
        for block in blocks(batches, "__text"):
            sets = shingle_sets(utf8(block, "__text"), k, seed)
            nodes = [set_id(s, seed) & -2 if len(s) else None for s in sets]
            checks = [set_id(s, seed + 1) if len(s) else None for s in sets]
            keys, own, slacks = [], [], []
            for s, node in zip(sets, nodes, strict=True):
                found, slack = [none, none], [0, 0]
                if node is not None and node not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    for i, b in enumerate(band_numbers(len(s), table, percent)):
                        found[i], slack[i] = segment_keys(s, table[b]), table[b].slack
                keys.append(np.concatenate(found))
                own.append(len(found[0]))
                slacks.append(slack)
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    block.column("body"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *keys]))),
                    pa.array(own, pa.int32()),
                    pa.array([x[0] for x in slacks], pa.int32()),
                    pa.array([x[1] for x in slacks], pa.int32()),
                ],
                names=["__key", "body", "n", "node", "check", "keys", "own", "slack0", "slack1"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"__key {kind}, body long, n long, node long, check long, keys array<long>, own int, slack0 int, slack1 int"
    return mapped(_texts(docs, key, text), run, schema)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("body"), F.col(text).alias("__text"))


def _sets(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """node, members (the sorted hashes as bytes) and sketch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            sets = shingle_sets(utf8(block, "__text"), k, seed)
            members = pa.array([s.tobytes() for s in sets], pa.binary())
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("node"), members, sketches], names=["node", "members", "sketch"])

    return mapped(texts.select("node", "__text"), run, "node long, members binary, sketch array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """s, u, v, nu and nv (sizes), d (members that only one has), linked, and delta (these members) of pairs (u, v) of nodes, of
    which s is any long."""
    sided = pairs.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    sided = sided.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").select("s", "u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, deltas = [], []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                delta = np.setxor1d(a, b, assume_unique=True)
                sizes.append((len(a), len(b), len(delta)))
                deltas.append(delta)
            nu, nv, d = (np.array([x[i] for x in sizes], np.int64) for i in range(3))
            ends = pa.array(np.cumsum(np.concatenate([np.zeros(1, np.int64), d])), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *deltas]))
            linked = pa.array(d * (100 + percent) <= (nu + nv) * (100 - percent))
            columns = [*(batch.column(c) for c in "suv"), pa.array(nu), pa.array(nv), pa.array(d), linked, pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["s", "u", "v", "nu", "nv", "d", "linked", "delta"])

    return mapped(sided, run, "s long, u long, v long, nu long, nv long, d long, linked boolean, delta array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node) of every node of some edges (u, v): each round every node joins its least neighbour,
    then what has joined is one node; the rounds are logarithmic in the longest chain."""
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    parts = 1 + edges.count() // ROWS_A_PART  # few edges, few files

    def kept(df: DataFrame, what: str) -> DataFrame:
        return written(df.coalesce(parts), what)

    roots = kept(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = kept(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("p")).select("x", F.least("x", "p").alias("p")), "parents")
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))  # one step up; the rest of a chain goes on next round
        parent = parent.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
        moved = roots.join(parent.withColumnsRenamed({"x": "root", "p": "to"}), "root", "left")
        roots = kept(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = edges.join(parent.withColumnsRenamed({"x": "u", "p": "pu"}), "u").join(parent.withColumnsRenamed({"x": "v", "p": "pv"}), "v")
        ends = ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct()
        edges = kept(ends, "edges")
    return roots


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    found = members.join(roots, "node", "left")
    return found.withColumn("root", F.coalesce("root", "node"))


def _key_rows(nodes: DataFrame) -> DataFrame:
    """k and owner, a row for each key of a set: the node, plus 1 for the keys of the band before its own."""
    rows = nodes.where("size(keys) > 0").select("node", "own", F.posexplode("keys").alias("pos", "k"))
    return rows.select("k", (F.col("node") + (F.col("pos") >= F.col("own")).cast("long")).alias("owner"))


def _hot_keys(nodes: DataFrame, count: int) -> DataFrame:
    """The most common keys in a sample of the sets, ``HOT_KEYS`` at most."""
    part = max(1, count // HOT_SETS)
    some = _key_rows(nodes.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0)).distinct()
    often = some.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_TIMES)
    return written(often.orderBy(F.desc("c"), "k").limit(HOT_KEYS).select("k"), "hot-keys")


def _kept_keys(nodes: DataFrame, count: int) -> DataFrame:
    """k, node and weight (how often its keys occur): the keys that different sets share, without the most common ones of each
    set, as many as the slack of its band. The rows of common keys stay where they are: their counts are broadcast."""
    rows, bounds = _key_rows(nodes), ("min(owner) as lo", "max(owner) as hi", "count(*) as c")
    hot = _hot_keys(nodes, count)
    apart = "lo <> hi"
    by_key = Window.partitionBy("k")
    cold = rows.join(F.broadcast(hot), "k", "left_anti")
    cold = cold.withColumns({"lo": F.min("owner").over(by_key), "hi": F.max("owner").over(by_key), "c": F.count("*").over(by_key)})
    often = rows.join(F.broadcast(hot), "k").groupBy("k").agg(*map(F.expr, bounds)).where(apart)
    warm = rows.join(F.broadcast(written(often, "hot-counts")), "k")  # HOT_KEYS rows at most
    columns = ("k", "owner", "c")
    shared = written(cold.where(apart).select(*columns).unionByName(warm.select(*columns)), "shared-keys")
    slacks = nodes.where("size(keys) > 0").groupBy("node").agg(F.max("slack0").alias("slack0"), F.max("slack1").alias("slack1"))
    # one shuffle, by node, for all that follows
    shared = shared.withColumns({"node": F.expr("owner & -2L"), "before": F.expr("owner & 1L")}).repartition("node").distinct().join(slacks, "node")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node", "before").orderBy(F.desc("c"), "k")))
    ranked = ranked.withColumn("weight", F.sum("c").over(Window.partitionBy("node")))
    return written(ranked.where("rank > if(before = 1, slack1, slack0)").select("k", "node", "weight"), "kept-keys")


def _node_sets(docs: DataFrame, key: str, text: str, k: int, seed: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and members of the wanted nodes, from one text for each; key and hash find it among the documents."""
    chosen = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("__key", "body")).alias("at"))
    chosen = written(chosen.select("node", F.col("at.__key").alias("the_key"), F.col("at.body").alias("the_body")), "compared")
    compared = chosen.count()
    same = F.col("__key").eqNullSafe(F.col("the_key")) & (F.col("body") == F.col("the_body"))
    found = _texts(docs, key, text).join(hinted(chosen, "100 + coalesce(octet_length(cast(the_key as string)), 0)"), same)
    sets = written(_sets(found, k, seed), "sets")
    if sets.count() > compared:  # rows that repeat key and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    return sets


def _indexed(docs: DataFrame, k: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node of every row, the kept keys of the sets that share one with another set, and these sets."""
    count = docs.count()
    sample = shingle_sets([t for t in sampled(docs, key, text, ALLOT_SETS)], k)
    seed = 0
    while True:
        table = allotted(percent, max(count, 1), [s for s in sample if len(s)])
        nodes = written(_nodes(docs, key, text, k, percent, table, seed), "shingles")
        clash = nodes.where("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
        if clash.where("lo <> hi").isEmpty():
            break
        seed += 2  # two sets of one id: all ids are drawn anew
    kept = _kept_keys(nodes, count)
    slim = written(nodes.select("__key", "body", "n", "node"), "nodes")
    discard(nodes)
    sets = _node_sets(docs, key, text, k, seed, slim, kept.select("node").distinct())
    return slim, kept, sets


def _stars(groups: DataFrame, by: str | None = None) -> DataFrame:
    """s, u (the pivot) and v of the members of groups g, where members are rows of node and weight: the pivot is the one of
    most weight. The groups of one pivot make one star, as far as they agree in the column ``by``, if there is one. A star of
    groups of one star ``by`` lacks its pivot, so it has fewer members than that, and there is a last one."""
    top = groups.groupBy("g").agg(F.max(F.struct("weight", "node")).alias("top"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    top = top.where("lo <> hi").select("g", F.col("top.node").alias("u"))
    found = groups.select("g", *([by] if by else []), F.col("node").alias("v")).join(top, "g").where("u <> v")
    return found.select((F.xxhash64(by, "u") if by else F.col("u")).alias("s"), "u", "v").distinct()


def _prefixes(found: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The next groups g (a star s and a difference from its pivot) and their members: node, n, d, place, root, weight; c and
    others, the members in all and those outside the component that has most, and minor, whether this one is such. ``found``
    are the stars as ``_compared`` has them, and m, a number of each row.

    Of two similar sets x and y with Dx and Dy differences from a pivot p, of which y isn't linked to p, D(x, y) <= q(|x| + |y|)
    and Dy > q(|y| + |p|), with q = (100 - percent) / (100 + percent); they share (Dx + Dy - D(x, y)) / 2 differences, which is
    more than (Dx + q(|p| - |x|)) / 2, and never negative as Dx >= |p| - |x|; and at least Dx - D(x, y). So both have the rarest
    of the differences that they share among their rarest ones, all but as many as they share for certain; and what stands
    before it in either (``place``) is not in the other. Members that are one component already, or all linked to the pivot,
    have nothing to tell.
    """
    # the differences themselves are read where they are, and leave it only as (m, g)
    rooted = found.drop("delta").join(hinted(roots, "16").withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    rooted = written(rooted, "rooted-stars")
    torn = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("linked").alias("all"))
    torn = written(torn.where("lo <> hi and not all").select("s"), "torn-stars")
    rows = found.select("m", "s", "delta").join(hinted(torn, "16"), "s", "left_semi")
    rows = rows.select("m", "s", F.explode("delta").alias("token")).select("m", F.xxhash64("s", "token").alias("g"))
    shared = rows.withColumn("c", F.count("*").over(Window.partitionBy("g"))).where("c > 1")  # a star's members at most
    member = Window.partitionBy("m")
    shared = shared.withColumns({"rank": F.row_number().over(member.orderBy("c", "g")), "some": F.count("*").over(member)})
    q, r = 100 - percent, 100 + percent
    placed = shared.join(rooted, "m").withColumns({
        "place": F.expr("d - some + rank - 1"),  # differences that no other member has come first
        "most": F.expr(f"(nv + nv * 100 div {percent}) * {q} div {r}"),  # how far a similar set can be apart
        "least": F.expr(f"if(linked, (d * {r} + (nu - nv) * {q}) div {2 * r} + 1, greatest(1, d - (nv + nv * 100 div {percent}) * {q} div {r}))"),
    }).where("place <= d - least")
    columns = ["g", "s", F.col("v").alias("node"), F.col("nv").alias("n"), "d", "place", "root", "linked", "most"]
    placed = written(placed.select(*columns), "differences")
    # a member that differs too much, by its place and the least one in the group, goes; then groups with nothing to tell
    least = placed.groupBy("g").agg(F.min("place").alias("first"))
    near = placed.join(least, "g").where("place + first <= most").drop("first", "most")
    parts = near.groupBy("g", "root").agg(F.count("*").alias("c"), F.min("linked").alias("all"))
    open_ = parts.groupBy("g").agg(
        F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("most"), F.min("all").alias("all"), F.count("*").alias("roots")
    )
    open_ = open_.where("roots > 1 and not all")
    open_ = open_.select("g", "c", (F.col("c") - F.col("most.c")).alias("others"), F.col("most.root").alias("top"))
    groups = near.drop("linked").join(open_, "g").withColumns({"minor": F.expr("root <> top"), "weight": -F.col("d")}).drop("top")
    groups = written(groups, "open-groups")
    discard(rooted, torn, placed)
    return groups


def _close_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), and differ, the bits in which their sketches do, of different components in groups that are compared directly, that can be similar by their sizes,
    differences, places and sketches. One of each pair is outside the group's largest component. Of the differences that two
    similar sets share, the rarest tells all in which they differ by place: those before it, and after it the difference in
    number at least."""
    small = groups.where(_DIRECT)
    apart = f"(u.n + v.n) * {100 - percent} div {100 + percent}"
    pairs = small.where("minor").alias("u").join(
        small.alias("v"),
        F.expr(
            f"u.g = v.g and (u.node < v.node or not v.minor) and u.root <> v.root"
            f" and {percent} * greatest(u.n, v.n) <= 100 * least(u.n, v.n)"
            f" and u.place + v.place + abs(u.d - u.place - v.d + v.place) <= {apart}"
        ),
    )
    pairs = pairs.select(F.least("u.node", "v.node").alias("u"), F.greatest("u.node", "v.node").alias("v"), F.expr(apart).alias("apart"))
    pairs = written(pairs.distinct(), "close-pairs")
    for side in "vu":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    differ = reduce(add, (F.bit_count(F.col("sketch_u")[i].bitwiseXOR(F.col("sketch_v")[i])) for i in range(SKETCH)))
    return pairs.withColumn("differ", differ).where("differ <= apart").select("u", "v", "differ")


def _torn_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't one component yet, and rank, from 1 for the most alike ones of the same two components."""
    for side in "uv":
        found = hinted(roots, "16").select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(found, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    two = Window.partitionBy(F.least("root_u", "root_v"), F.greatest("root_u", "root_v"))
    pairs = pairs.where("root_u <> root_v").withColumn("rank", F.row_number().over(two.orderBy("differ", "u", "v")))
    return pairs.drop("root_u", "root_v")


def _classes(kept: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and root of the nodes that links join: see the module's head."""
    spark = kept.sparkSession
    links = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "node long, root long")

    def linked(found: DataFrame) -> None:
        nonlocal links, roots
        more = found.where("linked").select("u", "v")
        if not more.isEmpty():
            links = written(links.unionByName(more), "links")
            roots = components(links)

    stars = written(_stars(kept.withColumnRenamed("k", "g")), "stars")
    while not stars.isEmpty():
        rest(spark)
        found = written(_compared(stars, sets, percent).withColumn("m", F.monotonically_increasing_id()), "compared-stars")
        discard(stars)
        linked(found)
        groups = _prefixes(found, roots, percent)
        discard(found)
        # one link of two components will do, so the most alike pairs come first, and more where these aren't linked
        close, most = written(_close_pairs(groups, sets, percent), "sketched-pairs"), FIRST_PAIRS
        while not close.isEmpty():
            torn = written(_torn_pairs(close, roots), "torn-pairs")
            some = torn.where(F.col("rank") <= most).withColumn("s", F.lit(0).cast("long"))
            wanted = hinted(some.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "16")
            few = sets.join(wanted, "node", "left_semi")
            linked(written(_compared(some, few, percent).select("u", "v", "linked"), "compared-pairs"))
            discard(close)
            close, most = torn.where(F.col("rank") > most).drop("rank"), most * MORE_PAIRS
        large = groups.where(f"not ({_DIRECT})")
        # several differences can have the same members: one of them will do
        same = large.groupBy("g").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.count("*").alias("c"))
        once = same.groupBy("who", "c").agg(F.min("g").alias("g")).select("g")
        stars = written(_stars(large.join(once, "g", "left_semi"), "s"), "stars")
        discard(groups)
    return roots


def _all_links(kept: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every link (u, v), u < v: the members of a key are compared with its later ones, ``CENTERS`` at a time."""
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("node")))
    ranked = written(ranked.select("k", "node", "rank"), "ranked-keys")
    last = ranked.agg(F.max("rank")).first()[0] or 0
    links = kept.sparkSession.createDataFrame([], "u long, v long")
    for done in range(0, last, CENTERS):
        u = ranked.where(f"rank > {done} and rank <= {done + CENTERS}").alias("u")
        pairs = ranked.alias("v").join(u, F.expr("u.k = v.k and u.rank < v.rank"))
        pairs = pairs.select(F.col("u.node").alias("u"), F.col("v.node").alias("v")).distinct()
        pairs = pairs.withColumn("s", F.lit(0).cast("long"))
        found = _compared(pairs, sets, percent).where("linked").select("u", "v")
        links = written(links.unionByName(found).distinct(), "links")
    return links


def similarity_classes(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row: documents whose sets of distinct k-word shingles have a Jaccard
    similarity of ``percent`` or more are linked, and a component's id is the least key that links reach.

    Words are runs without ASCII white space, A-Z in lower case; with fewer than k words the whole sequence is one shingle.
    Null, empty and wordless texts have no shingles and no links. Rows of equal sets are one node, so copies cost a row each;
    repeated keys are rows of their own, and a null key is never the least unless a component has no other. Other columns are
    ignored; an empty table gives no rows. No pair of different sets that reaches the similarity is lost: components are
    exact. Shingles are told apart by 64-bit hashes, sets by 128 bits.
    """
    every = _classified(docs, k, percent, key, text)
    least = every.where("root is not null").groupBy("root").agg(F.min("__key").alias("least"), F.count("*").alias("c")).where("c > 1")
    out = every.join(least, "root", "left")
    return out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "__key").alias("component_id"))


def _classified(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """__key, body, n, node and root of every row; rows of one component have one root, those without shingles none."""
    nodes, kept, sets = _indexed(docs, k, percent, key, text)
    roots = _classes(kept, sets, percent)
    discard(kept, sets)
    rest(docs.sparkSession)
    return _rooted(nodes, roots)


def similarity_links(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and n_links of every row: the number of other rows whose similarity with it, as in
    ``similarity_classes``, is ``percent`` or more. No link is skipped, so a group of n similar texts costs n² comparisons of its
    different sets; copies of a set are counted without being compared."""
    nodes, kept, sets = _indexed(docs, k, percent, key, text)
    links = _all_links(kept, sets, percent)
    copies = written(nodes.where("node is not null").groupBy("node").agg(F.count("*").alias("c")), "copies")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(copies.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("c").alias("others"))
    out = nodes.select("__key", "n", "node").join(copies, "node", "left").join(others, "node", "left")
    n_links = F.coalesce(F.col("c") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    return out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), n_links.alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the least key of each component, with all their columns, whatever their names.

    The least row is the one of least key, then of least hash of the text; a null key comes last. Of rows equal in both one
    stays. Null, empty and wordless texts have no shingles and all stay. An empty table gives no rows.
    """
    every = written(_classified(docs, k, percent, key, text).where("root is not null").select("__key", "body", "root"), "classes")
    place = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("the_key"), F.col("body").alias("the_body"))
    first = every.groupBy("root").agg(F.min(place).alias("first"))
    gone = every.join(first, "root").where(place != F.col("first")).select(place.alias("at")).distinct()
    gone = written(gone.select("at.the_key", "at.the_body"), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.xxhash64(text).alias("__body"))
    mine = F.col("__row")[key].eqNullSafe(F.col("the_key")) & (F.col("__body") == F.col("the_body"))
    kept = rows.join(hinted(gone, "64 + coalesce(octet_length(cast(the_key as string)), 0)"), mine, "left_anti")
    twice = every.groupBy("__key", "body").count().where("count > 1").select(F.col("__key").alias("the_key"), F.col("body").alias("the_body"))
    twice = written(_without(twice, gone), "twice")
    if not twice.isEmpty():
        again = kept.join(twice, mine, "left_semi")
        one = again.groupBy(F.col("__row")[key].alias("the_key"), "__body").agg(F.first("__row").alias("__row"))
        kept = kept.join(twice, mine, "left_anti").select("__row").unionByName(one.select("__row"))
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns))


def _without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """The pairs of key and hash that don't go."""
    them = gone.select(F.col("the_key").alias("k"), F.col("the_body").alias("b"))
    return pairs.join(them, F.col("the_key").eqNullSafe(F.col("k")) & (F.col("the_body") == F.col("b")), "left_anti")
