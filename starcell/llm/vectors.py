"""Embedding near-dedup: vectors with a high cosine, through a robust-pruned flat graph.

1. Equal vectors become one node. Centroids, fitted on a bounded sample, deal every node
   into its nearest shards, so that shards overlap; a shard above its limit is split by a hash.
2. Each shard builds its part of the graph in one task: near neighbours and a few far ones,
   robustly pruned. The adjacency lists of a node from all its shards are united.
3. Every node is a query in its nearest shards: a greedy beam search starts from the shard's
   medoid (and from the node itself where it is a member), and what it finds within range is
   expanded over neighbours in range until nothing new turns up. Cosines are computed in
   double precision, and only those that reach the limit count: nothing is approximate there.
4. Sampled queries are compared with all nodes, until enough of them have links. Where the
   mean recall of those with few, or with many, links is below its target, nodes are dealt to
   more shards and the beam is widened, up to all shards. After that, and where the sample
   has too few queries with links to prove anything, all pairs are compared, block by block.

A node's links are counted in the one shard that is home to the other end, weighted by its
copies. Pairs never leave a task: links come out as counts, and as a tree that connects what
a task has linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcell.llm.jaccard import Forest
from starcell.llm.shared import components, stored

COSINE = 0.9
# Bound of what the driver gets: sampled vectors, for the centroids and as queries of the audit.
SAMPLE = 10_000
# Queries of the audit's first round; each further one has four times as many.
AUDITED = 200
# Queries with links that an audit needs, and how many of them with fewer than ten links,
# unless all vectors are queries.
LINKED, FEW_LINKED = 100, 50
RECALL = 0.98
SHARD_ROWS = 2000
MOST_SHARD_ROWS = 4096
OVERLAP, PROBES = 2, 3
NEAR, FAR, CANDIDATES = 14, 4, 40
ALPHA = 1.2
BEAM = 16
# Cosine below the limit at which the expansion still goes on.
SLACK = 0.05
QUERIES = 512
# Nodes of a block where all pairs are compared.
BLOCK_ROWS = 8192

DEALT = "shard int, node bigint, copies bigint, rank int, vector binary"
BLOCKS = "one int, two int, block int, node bigint, copies bigint, vector binary"
FOUND = "node bigint, links bigint, a bigint, b bigint"
ROWS = "shard int, part int, node bigint, copies bigint, member boolean, home boolean, vector binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    random = np.random.default_rng(seed)
    centre = sample[random.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i:i + 4096] @ centre.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centre = np.where(length > 0, sums / np.where(length > 0, length, 1), centre)
    return centre


def robust_graph(v: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) among unit vectors: robustly pruned near neighbours, then far ones."""
    n = len(v)
    random = np.random.default_rng(seed)
    out = []
    step = max(1, min(256, (1 << 22) // max(1, n)))
    for low in range(0, n, step):
        own = np.arange(low, min(n, low + step))
        cosine = v[own] @ v.T
        cosine[np.arange(len(own)), own] = -2
        count = min(CANDIDATES, n - 1)
        near = np.argpartition(-cosine, count - 1, axis=1)[:, :count]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), 1, kind="stable"), 1)
        distance = 1 - np.take_along_axis(cosine, near, 1)
        among = 1 - v[near] @ np.swapaxes(v[near], 1, 2)
        alive = np.ones(near.shape, bool)
        for j in range(count):
            taken = alive[:, j]
            # A kept neighbour rules out later ones that are nearer to it than to the node.
            ruled = taken[:, None] & (ALPHA * among[:, j] <= distance)
            ruled[:, :j + 1] = False
            alive &= ~ruled
        alive &= np.cumsum(alive, 1) <= NEAR
        row, at = np.nonzero(alive)
        out.append((own[row], near[row, at]))
        far = random.integers(0, n, (len(own), FAR))
        row, at = np.nonzero(far != own[:, None])
        out.append((own[row], far[row, at]))
    return out


class Shard:
    """Members of a shard with their adjacency; `search` finds those in range of queries."""

    def __init__(self, v: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        self.v = v
        both = np.unique(np.concatenate((heads * len(v) + tails, tails * len(v) + heads)))
        heads, self.tails = both // len(v), both % len(v)
        self.begin = np.searchsorted(heads, np.arange(len(v) + 1))
        mean = v.mean(0)
        self.medoid = int((v @ mean).argmax())

    def neighbours(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.begin[nodes + 1] - self.begin[nodes]
        at = np.arange(int(count.sum())) + np.repeat(self.begin[nodes] - (np.cumsum(count) - count), count)
        return np.repeat(rows, count), self.tails[at]

    def search(self, q: np.ndarray, own: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs in range; `own` is a query's own place among the members, or -1."""
        n, width = len(self.v), min(beam, len(self.v))
        seen = np.zeros((len(q), n), bool)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        beam_nodes = np.full((len(q), width), -1)
        beam_cosine = np.full((len(q), width), -3.0)
        opened = np.ones((len(q), width), bool)

        def visit(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unseen ones of these pairs, ordered, with their cosines; those near the limit are kept."""
            new = ~seen[rows, nodes]
            pairs = np.unique(rows[new] * n + nodes[new])
            rows, nodes = pairs // n, pairs % n
            cosine = np.concatenate([np.zeros(0), *[
                np.einsum("ij,ij->i", q[rows[i:i + (1 << 15)]], self.v[nodes[i:i + (1 << 15)]])
                for i in range(0, len(rows), 1 << 15)]])
            seen[rows, nodes] = True
            some = cosine >= limit - SLACK
            near.append((rows[some], nodes[some], cosine[some]))
            return rows, nodes, cosine

        def keep_best(rows: np.ndarray, nodes: np.ndarray, cosine: np.ndarray) -> None:
            if not len(rows):
                return
            own_rows, first, count = np.unique(rows, return_index=True, return_counts=True)
            line = np.repeat(np.arange(len(own_rows)), count)
            place = np.arange(len(rows)) - np.repeat(first, count)
            shape = (len(own_rows), int(count.max()))
            more, its, done = np.full(shape, -1), np.full(shape, -3.0), np.ones(shape, bool)
            more[line, place], its[line, place], done[line, place] = nodes, cosine, False
            more = np.concatenate((beam_nodes[own_rows], more), 1)
            its = np.concatenate((beam_cosine[own_rows], its), 1)
            done = np.concatenate((opened[own_rows], done), 1)
            top = np.argpartition(-its, width - 1, axis=1)[:, :width]
            beam_nodes[own_rows], beam_cosine[own_rows], opened[own_rows] = (
                np.take_along_axis(x, top, 1) for x in (more, its, done))

        active = np.arange(len(q))
        member = active[own >= 0]
        keep_best(*visit(np.concatenate((active, member)),
                         np.concatenate((np.full(len(q), self.medoid), own[member]))))
        while len(active):
            best = np.where(opened[active], -3.0, beam_cosine[active]).argmax(1)
            going = ~opened[active, best]
            active, best = active[going], best[going]
            opened[active, best] = True
            keep_best(*visit(*self.neighbours(active, beam_nodes[active, best])))
        # Range expansion: everything near the limit passes its neighbours on.
        rest, near_all = near, []
        while rest:
            near = []
            rows, nodes, _ = (np.concatenate(x) for x in zip(*rest))
            near_all += rest
            visit(*self.neighbours(rows, nodes))
            rest = [x for x in near if len(x[0])]
        rows, nodes, cosine = (np.concatenate(x) for x in zip(*near_all))
        return rows[cosine >= limit], nodes[cosine >= limit]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _deal(centre: np.ndarray, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node in its nearest shards, with its rank among them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = unit(np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1))
        for i in range(0, len(v), 2048):
            part = v[i:i + 2048]
            nearest = np.argsort(-(part @ centre.T), 1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(part)), nearest.shape[1])
            take = pa.array(row + i)
            held = pa.array([x.tobytes() for x in part], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest.ravel().astype(np.int32)), batch.column("node").take(take),
                 batch.column("copies").take(take),
                 pa.array(np.tile(np.arange(nearest.shape[1], dtype=np.int32), len(part))),
                 held.take(pa.array(row))],
                ["shard", "node", "copies", "rank", "vector"])


def _by_key(names: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key of two ints, such as a shard part, after the other; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(names[0]).to_numpy().astype(np.int64) << 32 | batch.column(names[1]).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            if held and key[i] != last:
                yield pa.concat_batches(held)
                held = []
            last = key[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.concat_batches(held)


def _build(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_key(("shard", "part"), batches):
        node = rows.column("node").to_numpy()
        if len(node) < 2:
            continue
        edges = robust_graph(_matrix(rows.column("vector"), width))
        for heads, tails in edges:
            yield pa.RecordBatch.from_arrays([pa.array(node[heads]), pa.array(node[tails])], ["node", "next"])


def _search(width: int, limit: float, beam: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_key(("shard", "part"), batches):
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        member = np.flatnonzero(rows.column("member").to_numpy(zero_copy_only=False))
        if not len(member):
            continue
        member = member[np.argsort(node[member])]
        names = node[member]
        v = _matrix(rows.column("vector"), width)
        lists = rows.column("next").take(pa.array(member))
        heads = np.repeat(np.arange(len(member)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        tails = np.asarray(lists.flatten(), np.int64)
        at = np.minimum(np.searchsorted(names, tails), len(names) - 1)
        here = names[at] == tails
        shard = Shard(v[member], heads[here], at[here])
        home = rows.column("home").to_numpy(zero_copy_only=False)[member]
        own = np.minimum(np.searchsorted(names, node), len(names) - 1)
        own = np.where(names[own] == node, own, -1)
        forest = Forest(len(names))
        outside: list[tuple[int, int]] = []
        counts = np.zeros(len(node), np.int64)
        for i in range(0, len(node), QUERIES):
            q, m = shard.search(v[i:i + QUERIES], own[i:i + QUERIES], limit, beam)
            other = own[i + q] != m
            q, m = q[other] + i, m[other]
            counts += np.bincount(q, copies[member[m]] * home[m], len(node)).astype(np.int64)
            for x, y in zip(q.tolist(), m.tolist()):
                if own[x] >= 0:
                    forest.join(int(own[x]), y)
                else:
                    outside.append((int(node[x]), y))
        ties = {(int(names[forest.root(y)]), x) for x, y in outside}
        ties |= {(int(names[forest.root(y)]), int(names[y])) for y in range(len(names)) if forest.root(y) != y}
        some = np.flatnonzero(counts)
        empty = [None] * len(ties)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*node[some].tolist(), *empty], pa.int64()), pa.array([*counts[some].tolist(), *empty], pa.int64()),
             pa.array([*[None] * len(some), *[min(t) for t in ties]], pa.int64()),
             pa.array([*[None] * len(some), *[max(t) for t in ties]], pa.int64())], ["node", "links", "a", "b"])


def _compared(queries: np.ndarray, names: np.ndarray, limit: float,
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 22) // len(names))
    for batch in batches:
        if not batch.num_rows:
            continue
        v = unit(np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1))
        node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
        found = np.zeros(len(names), np.int64)
        for i in range(0, len(v), step):
            near = (queries @ v[i:i + step].T >= limit) & (names[:, None] != node[None, i:i + step])
            found += near @ copies[i:i + step]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(found[some])], ["node", "links"])


def _audit(nodes: DataFrame, drawn: np.ndarray, names: np.ndarray, count: int, limit: float) -> tuple[dict, bool]:
    """Links of the sampled queries that have any, and whether they are enough to prove a recall."""
    true: dict[int, int] = {}
    low, high = 0, AUDITED
    while low < len(names):
        rows = nodes.mapInArrow(partial(_compared, drawn[low:high], names[low:high], limit), "node bigint, links bigint") \
            .groupBy("node").agg(F.sum("links").alias("links")).collect()      # one row per audited query
        true |= {r["node"]: r["links"] for r in rows}
        if len(true) >= LINKED and sum(n < 10 for n in true.values()) >= FEW_LINKED:
            return true, True
        low, high = high, 5 * high
    return true, len(names) == count


def reached(true: dict[int, int], got: dict[int, int], recall: float) -> bool:
    """Whether the mean recall of queries is high enough, for each power of ten of their links."""
    kinds: dict[int, list[float]] = {}
    for x, n in true.items():
        kinds.setdefault(len(str(n)), []).append(min(n, got.get(x, 0)) / n)
    return all(sum(r) >= recall * len(r) for r in kinds.values())


def _blocks(blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once for every pair of blocks that its own is in."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = unit(np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1))
        held, own = pa.array([x.tobytes() for x in v], pa.binary()), batch.column("block").to_numpy()
        for other in range(blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(own, other).astype(np.int32)), pa.array(np.maximum(own, other).astype(np.int32)),
                 batch.column("block"), batch.column("node"), batch.column("copies"), held],
                ["one", "two", "block", "node", "copies", "vector"])


def _scan(width: int, limit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and ties of all pairs between two blocks, or within one."""
    for rows in _by_key(("one", "two"), batches):
        rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy())))
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        block = rows.column("block").to_numpy()
        v = _matrix(rows.column("vector"), width)
        within = rows.column("one")[0] == rows.column("two")[0]
        left = np.flatnonzero(block == rows.column("one")[0].as_py())
        right = left if within else np.flatnonzero(block != rows.column("one")[0].as_py())
        counts, root, forest = np.zeros(len(node), np.int64), np.arange(len(node)), Forest(len(node))
        its, weights = v[right], copies[right]
        for i in range(0, len(left), QUERIES):
            own = left[i:i + QUERIES]
            near = v[own] @ its.T >= limit
            if within:
                near[np.arange(len(own)), np.arange(i, i + len(own))] = False
            counts[own] += near @ weights
            if not within:
                counts[right] += copies[own] @ near
            q, m = np.nonzero(near)
            x, y = root[own[q]], root[right[m]]
            ties = np.unique(x[x != y] * len(node) + y[x != y])
            for tie in ties.tolist():
                forest.join(*divmod(tie, len(node)))
            if len(ties):
                root = np.array([forest.root(x) for x in range(len(node))])
        some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*node[some].tolist(), *[None] * len(tied)], pa.int64()),
             pa.array([*counts[some].tolist(), *[None] * len(tied)], pa.int64()),
             pa.array([*[None] * len(some), *node[root[tied]].tolist()], pa.int64()),
             pa.array([*[None] * len(some), *node[tied].tolist()], pa.int64())], ["node", "links", "a", "b"])


def _compared_all(nodes: DataFrame, count: int, width: int, limit: float) -> DataFrame:
    """What _found gives, of all pairs."""
    blocks = -(-count // BLOCK_ROWS)
    rows = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")) \
        .mapInArrow(partial(_blocks, blocks), BLOCKS)
    return stored(rows.repartition("one", "two").sortWithinPartitions("one", "two")
                  .mapInArrow(partial(_scan, width, limit), FOUND), "vector-found")


def _found(nodes: DataFrame, centre: np.ndarray, width: int, limit: float, overlap: int, probes: int,
           beam: int) -> DataFrame:
    """Counts (node, links) and ties (a, b) of one search over all nodes."""
    dealt = stored(nodes.mapInArrow(partial(_deal, centre, max(overlap, probes)), DEALT), "vector-shards")
    sizes = dealt.where(F.col("rank") < overlap).groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) / MOST_SHARD_ROWS).cast("int").alias("parts"))
    # One row per centroid, of which there are fewer than sampled vectors.
    rows = dealt.join(F.broadcast(sizes), "shard").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "shard", F.col("part").cast("int").alias("part"), "node", "copies",
        ((F.col("rank") < overlap) & (F.col("part") == F.col("mine"))).alias("member"),
        ((F.col("rank") == 0) & (F.col("part") == F.col("mine"))).alias("home"), "vector")
    edges = stored(rows.where("member").repartition("shard", "part").sortWithinPartitions("shard", "part")
                   .mapInArrow(partial(_build, width), "node bigint, next bigint"), "vector-edges")
    # A node has at most NEAR + FAR neighbours from each of its `overlap` shards.
    lists = edges.groupBy("node").agg(F.collect_set("next").alias("next"))
    joined = rows.join(lists, "node", "left").withColumn("next", F.when(F.col("member"), F.col("next")))
    return stored(joined.repartition("shard", "part").sortWithinPartitions("shard", "part")
                  .mapInArrow(partial(_search, width, limit, beam), FOUND), "vector-found")


def near_duplicates(vectors: DataFrame, limit: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): n_links, component_id and kept are added.

    n_links counts the other rows with a cosine of at least `limit`, component_id is the
    smallest vec_id reachable, kept tells whether it is the row's own (null ids: of an all-null
    component). Vectors that are null, empty, zero, hold null or non-finite components, or have
    another length than most, link with nothing. Equal rows link with each other; an empty
    table gives an empty result; columns with the added names are replaced.
    """
    rows = vectors.drop("n_links", "component_id", "kept")
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    lengths = rows.where(fit).groupBy(F.size("embedding").alias("n")).count()
    most = lengths.orderBy(F.desc("count"), "n").first()
    width = int(most["n"]) if most else 0
    fit = F.coalesce(fit & (F.size("embedding") == width), F.lit(False))
    nodes = stored(rows.where(fit).groupBy("embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    count = nodes.count()
    share = int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))
    place = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    sample = nodes.where(place < share).select("node", "embedding", place.alias("place")).toPandas() \
        .sort_values("place", kind="stable")
    if len(sample) < 2:
        sample = nodes.limit(2).select("node", "embedding").toPandas()
    if len(sample):
        drawn = unit(np.stack(sample["embedding"]).astype(np.float64))
        k = max(1, min(len(drawn) // 8, -(-OVERLAP * count // SHARD_ROWS)))
        centre = centroids(drawn, k)
        names = sample["node"].to_numpy()
        true, proves = _audit(nodes, drawn, names, count, limit)
        overlap, probes, beam = min(OVERLAP, k), min(PROBES, k), BEAM
        while proves:
            found = _found(nodes, centre, width, limit, overlap, probes, beam)
            got = found.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in true], "node bigint")), "node") \
                .groupBy("node").agg(F.sum("links").alias("links")).collect()      # one row per audited query
            if reached(true, {r["node"]: r["links"] for r in got}, recall) or probes == k:
                break
            overlap, probes, beam = min(k, overlap + 1), min(k, 2 * probes), 2 * beam
        if not proves or not reached(true, {r["node"]: r["links"] for r in got}, recall):
            found = _compared_all(nodes, count, width, limit)
    else:
        found = rows.sparkSession.createDataFrame([], FOUND)
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("a is not null").select("a", "b"), "vector-classes")
    named = nodes.join(links, "node", "left").join(classes, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select(
        F.col("embedding").alias("__vector"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-names")
    out = rows.withColumn("__fit", fit).join(named, F.col("__fit") & (F.col("embedding") == F.col("__vector")), "left")
    return out.select(
        *[f"`{c}`" for c in rows.columns], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("__vector").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
