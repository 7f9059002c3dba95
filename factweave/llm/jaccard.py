"""Chosen-path similarity join of documents by the Jaccard similarity of their word shingles.

Equal sets of shingles are one node. A run sends each node down the paths of shared tokens that it chooses: first a token
is chosen if its hash, with the run, lies below 1 / (``JACCARD`` * size), so similar sets choose alike and about one token
each. Nodes that share a bucket are candidates; a bucket that is larger than ``SMALL`` is split by the next level, where tokens
are chosen among the 64 that a node's sketch has sampled, 1 in ``DEEPER`` * 64: similar nodes share most samples, so a
true pair stays together the likelier, while buckets of nodes that have little more than a passage in common shrink. Before each
split the nodes of a large bucket meet a few pivots of it, in one distributed pass: those next to a pivot (near copies) are
done. A large bucket of which all but a few nodes are joined already goes no level down: those few, the strangers, meet all the
others in small buckets, so a group of near copies doesn't grow from level to level. Levels go on until no bucket is large; none is
dropped, or taken whole in one task.

Runs repeat this, as many as ``recall`` asks for (``runs_for``): that counts with pairs at the very threshold, one set of which
holds the other, so that they choose one common first token on average and none chooses fewer, and that meet in
buckets which stay large on every level. All other pairs are lost less often.

The first runs are a wave of their own: what they join has one label from then on, and a bucket of one label is passed over.
A small bucket is brute-forced with sketches (64 one-permutation minima a node), not by all pairs: a pivot takes in all that
may be near enough to be linked with what it covers, those next to it need not be pivots, and none looks at what is
joined with it already; so a bucket gives fewer edges than it has members. What edges join is then compared exactly, set by set, in
tasks of at most two lots of ``LOT`` sets, and links are counted there rather than listed.

Result: a class (what links join) and the number of links for each document, so copies cost nothing more. Texts
without words have no shingles and no links; null texts count as empty. Rows without an id come after all ids and
have a class of their own number only if they are linked. Repeated rows count as copies of each other. Extra columns are not
looked at. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import TOKEN_BITS, mix, raw, runs, strings, table, token_sets, written
from factweave.llm.components import components

JACCARD, WORDS = 0.8, 5
SMALL, LOT = 200, 1024
#: The share of pairs at the threshold that share a small bucket in some run, at least.
RECALL = 0.995
#: Runs of the first wave; the share of samples that counts below the first level; pivots of a large bucket.
FIRST_WAVE, DEEPER, PIVOTS = 2, 0.6, 8


def runs_for(recall: float) -> int:
    """How many runs give the recall to a pair at the threshold that meets in large buckets alone.

    Such a pair has as many common first buckets as a Poisson variable of mean 1, and below each bucket, on every level, as
    many as one of mean ``JACCARD / DEEPER``.
    """
    ends = 0.0  # the probability that all common paths below a bucket end somewhere
    for _ in range(1000):
        ends = math.exp((ends - 1) * JACCARD / DEEPER)
    return math.ceil(math.log(1 - recall) / (ends - 1))


BINS = 64
#: Estimates from which on a pivot takes a node in, and from which on that node needs no pivot of its own: two sets
#: with similarity J have distance 1 - J, which obeys the triangle inequality, and estimates err by four deviations.
TAKEN_IN, DONE = 0.3, 0.9
_NO_ID = (1 << 63) - 1


def keys(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set; 0 and 0 for an empty one."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(seed)), dtype=np.uint64)])
        found = mix(sums[begins[1:]] - sums[begins[:-1]] + np.diff(begins).astype(np.uint64))
        out.append(np.where(np.diff(begins) > 0, found, np.uint64(0)).view(np.int64))
    return out[0], out[1]


def sketches(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A byte for each of the bins of a set's hashes: of the least one in it; 0 where there is none."""
    n = len(begins) - 1
    row = np.repeat(np.arange(n), np.diff(begins))
    h = mix(tokens + np.uint64(0x2545F4914F6CDD1D))
    least = np.full(n * BINS, ~np.uint64(0))
    np.minimum.at(least, row * BINS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
    return np.where(least == ~np.uint64(0), 0, 1 + mix(least) % np.uint64(255)).astype(np.uint8).reshape(n, BINS)


def estimated(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of equal bins among those that one of the two fills."""
    filled = (others != 0) | (sketch != 0)
    return ((others == sketch) & filled).sum(1) / np.maximum(filled.sum(1), 1)


def _limit(size: np.ndarray, share: float) -> np.ndarray:
    """Hashes below it choose: one token in share * size."""
    return (2.0**64 / np.maximum(share * size, 1.0)).clip(max=2.0**64 - 4096).astype(np.uint64)


def first_buckets(tokens: np.ndarray, begins: np.ndarray, these: range, jaccard: float = JACCARD) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token that the runs choose, by row."""
    size = np.diff(begins)
    row = np.repeat(np.arange(len(size)), size)
    limit = _limit(size, jaccard)[row]
    rows, buckets = [], []
    for run in these:
        start = mix(np.array([run + 1], np.uint64) * np.uint64(0xA0761D6478BD642F))
        chosen = np.flatnonzero(mix(start ^ tokens) < limit)
        rows.append(row[chosen])
        buckets.append(mix(start * np.uint64(0x9E3779B97F4A7C15) + tokens[chosen]))
    row, bucket = np.concatenate([row[:0], *rows]), np.concatenate([tokens[:0], *buckets])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def next_buckets(bucket: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket, a level below, of each sample that the rows choose."""
    sample = sketch.astype(np.uint64) + np.arange(BINS, dtype=np.uint64) * np.uint64(256)
    h = mix(mix(bucket)[:, None] ^ (sample * np.uint64(0xA0761D6478BD642F)))
    chosen = (h < _limit((sketch != 0).sum(1), DEEPER)[:, None]) & (sketch != 0)
    row, at = np.nonzero(chosen)
    return row, mix(bucket[row] * np.uint64(0x9E3779B97F4A7C15) + sample[row, at])


def signatures(docs: DataFrame, waves: list[range]) -> DataFrame:
    """``at, key1, key2, size, sketch`` of each document, and for each wave of runs its first buckets."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch.column("text")))
            for lo, hi in runs(offsets):
                tokens, begins = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                one, two = keys(tokens, begins)
                columns = [batch.column("at")[lo:hi], pa.array(one), pa.array(two), pa.array(np.diff(begins)), pa.array([x.tobytes() for x in sketches(tokens, begins)], pa.binary())]
                for these in waves:
                    row, bucket = first_buckets(tokens, begins, these)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(bucket.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["at", "key1", "key2", "size", "sketch", *(f"tops{w}" for w in range(len(waves)))])

    tops = ", ".join(f"tops{w} array<bigint>" for w in range(len(waves)))
    return docs.select("at", "text").mapInArrow(part, f"at long, key1 long, key2 long, size long, sketch binary, {tops}")


def _segments(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; a group stays in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.zeros(batch.num_rows, bool)
        for c in by:
            x = batch.column(c).to_numpy()
            key[1:] |= x[1:] != x[:-1]
        cut = int(np.flatnonzero(key)[-1]) if key.any() else 0
        same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in by)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(t: pa.Table, *by: str) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in by:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def bucket_edges(sketch: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a bucket that join those which may be linked: as few as that takes.

    Places of one label are joined already. A pivot looks only at what isn't joined with it yet. Places that are next to
    a pivot need not be pivots: all that may be linked with them has been near enough to that pivot to be joined with it.
    """
    n = len(sketch)
    joined, done = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1], np.zeros(n, bool)
    a, b = [], []
    for pivot in range(n):
        if done[pivot]:
            continue
        others = np.flatnonzero(joined != joined[pivot])
        if not len(others):
            break
        near = estimated(sketch[pivot], sketch[others])
        done[others[near >= DONE]] = True
        groups, at = np.unique(joined[others[near >= TAKEN_IN]], return_index=True)
        if len(groups):
            a.append(np.full(len(groups), pivot))
            b.append(others[near >= TAKEN_IN][at])
            joined[np.isin(joined, groups)] = joined[pivot]
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def candidate_edges(members: DataFrame) -> DataFrame:
    """``a, b``: edges from small buckets (``bucket, node, label, sketch``)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "bucket"):
            cuts = _cuts(t, "bucket")
            node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
            sketch = _sketches(t.column("sketch"))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = cuts[:-1][np.diff(cuts) == 2]
            if len(two):
                x, y = sketch[two], sketch[two + 1]
                filled = (x != 0) | (y != 0)
                near = ((x == y) & filled).sum(1) >= TAKEN_IN * np.maximum(filled.sum(1), 1)
                a.append(two[near])
                b.append(two[near] + 1)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 2:
                    i, j = bucket_edges(sketch[lo:hi], label[lo:hi])
                    a.append(i + lo)
                    b.append(j + lo)
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(a)]), pa.array(node[np.concatenate(b)])], ["a", "b"])

    return members.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(part, "a long, b long")


def pivot_heads(pivots: np.ndarray) -> np.ndarray:
    """For the pivots of each bucket the first one that those near one another join each with."""
    filled = (pivots[:, :, None] != 0) | (pivots[:, None] != 0)
    reach = ((pivots[:, :, None] == pivots[:, None]) & filled).sum(3) >= TAKEN_IN * np.maximum(filled.sum(3), 1)
    reach |= np.eye(pivots.shape[1], dtype=bool)
    for _ in range(PIVOTS.bit_length()):
        reach = reach @ reach
    return reach.argmax(2)


def split(large: DataFrame) -> DataFrame:
    """One level of large buckets (``bucket, node, label, sketch``): all nodes against ``PIVOTS`` nodes of the bucket, then down.

    Edges ``a, b`` (``node`` null) join a node with the first pivot that takes it in, pivots that are near one another, and pivots
    that take in the same. They are drawn between labels, so what is joined already is named once for some rows. A node next to
    a pivot is done; the others go to buckets a level below, with one label for all that near pivots take in. Each bucket's pivots
    are one row.
    """
    pivots = large.groupBy("bucket").agg(F.array(*(F.min_by(F.struct("node", "label", "sketch"), F.xxhash64("node", F.lit(k))) for k in range(PIVOTS))).alias("pivots"))
    pivots = pivots.select("bucket", F.transform("pivots", lambda p: p["node"]).alias("nodes"), F.transform("pivots", lambda p: p["label"]).alias("labels"), F.transform("pivots", lambda p: p["sketch"]).alias("sketches"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of pivots' labels
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                node, label, bucket = (batch.column(c).to_numpy() for c in ("node", "label", "bucket"))
                sketch = _sketches(batch.column("sketch"))
                names, classes = (batch.column(c).flatten().to_numpy().reshape(-1, PIVOTS) for c in ("nodes", "labels"))
                others = _sketches(batch.column("sketches").flatten()).reshape(-1, PIVOTS, BINS)
                filled = (others != 0) | (sketch[:, None, :] != 0)
                near = ((others == sketch[:, None, :]) & filled).sum(2) / np.maximum(filled.sum(2), 1)
                taken = near >= TAKEN_IN
                _, first, which = np.unique(bucket, return_index=True, return_inverse=True)
                heads = pivot_heads(others[first])[which]
                at, row = taken.argmax(1), np.arange(len(node))
                met = taken[row, at]
                pivot, head, joined = names[row, at], heads[row, at], classes[row, at]
                own = np.where(met, classes[row, head], label)
                joins = met & (label != joined) & (label != own)
                # pivots that are near one another are joined where one of them is the row, others where a row is near both
                is_pivot = (names == node[:, None]).any(1)
                also, which = np.nonzero(taken & (names != pivot[:, None]) & (is_pivot[:, None] | (heads != head[:, None])))
                pairs = set(zip(joined[also].tolist(), classes[also, which].tolist())) - seen
                seen |= pairs
                pairs = np.array(sorted(x for x in pairs if x[0] != x[1]), np.int64).reshape(-1, 2).T
                a, b = np.unique(np.concatenate([np.stack([joined[joins], label[joins]]), pairs], axis=1), axis=1)
                rest = np.flatnonzero(near.max(1) < DONE)
                row, below = next_buckets(bucket[rest].view(np.uint64), sketch[rest])
                row = rest[row]
                none = lambda n, kind: pa.nulls(n, kind)
                columns = [(pa.array(a), none(len(row), pa.int64())), (pa.array(b), none(len(row), pa.int64())), *((none(len(a), pa.int64()), pa.array(x)) for x in (below.view(np.int64), node[row], own[row])), (none(len(a), pa.binary()), batch.column("sketch").take(pa.array(row)))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "bucket", "node", "label", "sketch"])

    return large.join(pivots, "bucket").select("bucket", "node", "label", "sketch", "nodes", "labels", "sketches").mapInArrow(part, "a long, b long, bucket long, node long, label long, sketch binary")


def lopsided(large: DataFrame) -> DataFrame:
    """``bucket, main, shares``: buckets in which at most a third of ``SMALL`` nodes, the strangers, have another label than ``main``.

    Only pairs of two labels can join anything, so it takes no level below: ``shares`` are as many as make small buckets of the
    strangers and one share of the others each.
    """
    counts = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    strangers = F.col("n") - F.col("most.n")
    shares = F.ceil(F.col("most.n") / (2 * (SMALL - strangers) / 3)).cast("long")
    return most.where(strangers <= SMALL // 3).select("bucket", F.col("most.label").alias("main"), shares.alias("shares"))


def shared_out(large: DataFrame, sides: DataFrame) -> DataFrame:
    """Rows of ``lopsided`` buckets anew: a node of the main label in one share's bucket, a stranger in each."""
    share = F.pmod(F.xxhash64("bucket", "node"), F.col("shares"))
    at = F.when(F.col("label") == F.col("main"), F.array(share)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    rows = large.join(sides, "bucket").select("bucket", F.explode(at).alias("share"), "node", "label", "sketch")
    return rows.select(F.xxhash64("bucket", "share").alias("bucket"), "node", "label", "sketch")


def wave_edges(first: DataFrame, wave: int, labels: DataFrame | None) -> DataFrame:
    """``a, b`` of a wave of runs; ``labels``: what earlier waves joined (``node, component``), which isn't looked at again."""
    sketch = first.select("node", "sketch")
    small, edges = [], []

    def parted(rows: DataFrame) -> DataFrame:
        """The rows of large buckets; those of small ones are put aside. Buckets of one label are passed over."""
        spread = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket", "n")
        spread = written(spread)
        small.append(rows.join(spread.where(F.col("n") <= SMALL), "bucket", "left_semi"))
        return rows.join(spread.where(F.col("n") > SMALL), "bucket", "left_semi")

    rows = first.select(F.explode(f"tops{wave}").alias("bucket"), "node")  # a node chooses no bucket twice, here or below
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:  # only what is shared at all meets the labels
        shared = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
        rows = rows.join(shared, "bucket", "left_semi").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
        rows = written(rows)
    large = written(parted(rows).join(sketch, "node").select("bucket", "node", "label", "sketch"))
    small[0] = small[0].join(sketch, "node").select("bucket", "node", "label", "sketch")
    while not large.isEmpty():
        sides = written(lopsided(large))
        level = split(large.join(sides, "bucket", "left_anti"))
        passed = written(level.unionByName(shared_out(large, sides), allowMissingColumns=True), few=False)
        edges.append(passed.where("node is null").select("a", "b"))
        large = written(parted(passed.where("node is not null").select("bucket", "node", "label", "sketch")))
    out = candidate_edges(reduce(DataFrame.unionByName, small))
    return written(reduce(DataFrame.unionByName, edges, out), few=False)


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) * 8 // TOKEN_BITS, 8), np.uint8)
    wide[:, : TOKEN_BITS // 8] = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BITS // 8)
    return wide.view("<u8").ravel()


def _common(sets: list[np.ndarray], lots: np.ndarray, one: int, other: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and sizes of intersections, some rows at a time, between two lots (or within one)."""
    rows = np.flatnonzero(lots == one)
    columns = rows if one == other else np.flatnonzero(lots == other)
    every = np.concatenate([sets[i] for i in (rows if one == other else [*rows, *columns])])
    words, index, count = np.unique(every, return_inverse=True, return_counts=True)
    # tokens of one set alone are in no intersection
    place = np.cumsum(count > 1) - 1
    keep = count[index] > 1
    which = np.repeat(np.arange(len(rows) if one == other else len(rows) + len(columns)), [len(sets[i]) for i in (rows if one == other else [*rows, *columns])])
    which, token = which[keep], place[index[keep]]
    total, width = np.zeros((len(rows), len(columns)), np.float32), 4096
    order = np.argsort(token, kind="stable")
    which, token = which[order], token[order]
    n = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, n, width):
        at = slice(*np.searchsorted(token, [lo, lo + width]))
        held = np.zeros((len(rows) if one == other else len(rows) + len(columns), min(width, n - lo)), np.float32)
        held[which[at], token[at] - lo] = 1
        total += held[: len(rows)] @ (held if one == other else held[len(rows) :]).T
    yield rows, columns, total


def exact_links(sets: list[np.ndarray], lots: np.ndarray, one: int, other: int, jaccard: float = JACCARD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose sets have at least that similarity, each pair once."""
    size = np.array([len(s) for s in sets])
    a, b = [], []
    for rows, columns, common in _common(sets, lots, one, other):
        union = size[rows][:, None] + size[columns][None, :] - common
        near = common >= jaccard * union - 1e-6
        if one == other:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        a.append(rows[i])
        b.append(columns[j])
    return np.concatenate(a), np.concatenate(b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is joined with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verified(texts: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``key1, key2, node, root, links, linked_sets``: sums over tasks of what each node is linked with.

    ``texts``: the text of a document of each node, with ``key1, key2, copies, component, lot, lots``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch.column("text")))
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("key1", "key2", "copies", "component", "lot", "lots")]
            for lo, hi in runs(offsets):
                tokens, begins = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                one, two = keys(tokens, begins)
                for r in range(lo, hi):
                    k1, k2, copies, component, lot, lots = (c[r] for c in columns)
                    if (k1, k2) != (one[r - lo], two[r - lo]):
                        continue  # another document with the same id
                    held = _packed(tokens[begins[r - lo] : begins[r - lo + 1]])
                    out += [(component, min(lot, x), max(lot, x), lot, k1, k2, copies, held) for x in range(lots)]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], ["component", "one", "other", "lot", "key1", "key2", "copies", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "component", "one", "other"):
            cuts = _cuts(t, "component", "one", "other")
            one, other, lots, key1, key2, copies = (t.column(c).to_numpy() for c in ("one", "other", "lot", "key1", "key2", "copies"))
            packed = t.column("tokens").to_pylist()
            out = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                # a node may come with several documents of one id; the first of each stands
                at = lo + np.sort(np.unique(np.stack([key1[lo:hi], key2[lo:hi]]), axis=1, return_index=True)[1])
                sets = [_unpacked(packed[i]) for i in at]
                a, b = exact_links(sets, lots[at], int(one[lo]), int(other[lo]), jaccard)
                n = len(at)
                weight = copies[at]
                links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
                linked = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                root = key1[at][_roots(n, a, b)]
                out.append((key1[at], key2[at], root, links.astype(np.int64), linked.astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key1", "key2", "root", "links", "linked_sets"])

    dealt = texts.mapInArrow(deal, "component long, one long, other long, lot long, key1 long, key2 long, copies long, tokens binary")
    return dealt.repartition("component", "one", "other").sortWithinPartitions("component", "one", "other", "key1", "key2").mapInArrow(compare, "key1 long, key2 long, root long, links long, linked_sets long")


def join(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, n_linked_sets, n_copies`` of each document.

    ``class_id``: the least id among all documents that links join with it. ``n_links``: the other documents that are
    as similar, copies too; ``n_linked_sets``: how many different sets those have beside its own; ``n_copies``: how
    many documents have its very set (itself counts).
    """
    if jaccard < JACCARD:
        raise ValueError("sketches and paths are laid out for similarities from 0.8 on")
    n_runs = runs_for(recall)
    waves = [range(0, min(FIRST_WAVE, n_runs)), *([range(FIRST_WAVE, n_runs)] if n_runs > FIRST_WAVE else [])]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("at"), "text")
    found = written(signatures(texts, waves).withColumn("row", F.monotonically_increasing_id()), few=False)
    classes = found.where("size > 0").groupBy("key1", "key2").agg(F.min(F.struct("at", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("key1", "key2", F.col("first.at").alias("first_at"), F.col("first.row").alias("first_row"), "copies"))
    own = classes.select("key1", "key2", F.col("first_at").alias("at"), F.col("first_row").alias("row"))
    first = found.join(own, ["key1", "key2", "at", "row"], "left_semi")
    first = written(first.select(F.col("key1").alias("node"), "sketch", *(f"tops{w}" for w in range(len(waves)))), few=False)
    near = None
    for wave in range(len(waves)):
        edges = wave_edges(first, wave, near)
        if near is not None:
            edges = edges.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b")))
        near = components(edges)
    size = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    near = near.join(size, "component").withColumn("lots", F.ceil(F.col("n") / LOT).cast("long")).withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")))
    wanted = near.join(classes, near["node"] == classes["key1"]).select("key1", "key2", "copies", "component", "lot", "lots", "first_at")
    wanted = written(wanted)
    # texts are dealt out by id at every size, so the join costs the same share of the input
    own = texts.hint("merge").join(wanted, texts["at"] == wanted["first_at"]).select("key1", "key2", "copies", "component", "lot", "lots", "text")
    linked = written(verified(own, jaccard), few=False)
    joined = components(linked.where("root <> key1").select(F.col("key1").alias("a"), F.col("root").alias("b")))
    sums = linked.groupBy("key1", "key2").agg(F.sum("links").alias("links"), F.sum("linked_sets").alias("linked_sets"))
    sums = sums.join(joined, sums["key1"] == joined["node"], "left").select("key1", "key2", "links", "linked_sets", F.coalesce("component", "key1").alias("component"))
    per = classes.join(sums, ["key1", "key2"], "left").withColumn("component", F.coalesce("component", "key1"))
    ids = per.groupBy("component").agg(F.min("first_at").alias("class_at"))
    per = written(per.join(ids, "component").select("key1", "key2", "class_at", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_sets", F.lit(0)).alias("linked_sets"), "copies"))
    out = found.select("at", "key1", "key2").join(per, ["key1", "key2"], "left")
    real = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return out.select(
        real("at").alias("doc_id"),
        F.coalesce(real("class_at"), real("at")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("linked_sets", F.lit(0)).cast("long").alias("n_linked_sets"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), tokens AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - {WORDS - 1}) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS t FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS own FROM tokens GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens AS a JOIN tokens AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT c.a, c.b, x.own = y.own AS same, y.own AS other FROM common AS c JOIN sizes AS x ON c.a = x.doc_id JOIN sizes AS y ON c.b = y.doc_id WHERE c.n >= {JACCARD} * (x.n + y.n - c.n) - 1e-9
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
), classes AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a
), counts AS (
  SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT other) FILTER (WHERE NOT same) AS n_linked_sets, 1 + count(*) FILTER (WHERE same) AS n_copies FROM links GROUP BY a
)
SELECT c.doc_id, c.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_linked_sets, 0) AS n_linked_sets, coalesce(n_copies, 1) AS n_copies
FROM classes AS c LEFT JOIN counts AS n ON c.doc_id = n.doc_id
"""
