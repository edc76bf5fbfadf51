"""Exact top-k by inner product with a dual-tree search over cover trees.

Components are turned into integers (``floor(scale * x)``), so scores are exact. At most ``PIVOTS`` rows, picked by
hash, are the coarse top level: vectors are dealt into blocks of about ``BLOCK`` rows of one nearest pivot, queries into
blocks of ``QUERY_BLOCK``. Each block has a cover tree and a summary, its root's centre and radius. Query blocks
are first searched against one block of their own pivot, which gives every query a k-th score to beat; then
summaries meet summaries, and only pairs of blocks whose bound is not below the worst of these scores are moved
and searched, up to ``TOGETHER`` vector blocks of a query block in one task. In a tree, every node has a centre and a covering radius, its children's
centres lie apart and cover it with radii smaller by ``BASE``. The search descends both trees together: a
group of sibling query nodes meets the vector nodes that are left for it, best bound first. No score of a
pair of nodes is above

    centre . centre + radius_q * |centre_r| + radius_r * |centre_q| + radius_q * radius_r

and a vector node is pruned when that is below the worst k-th score of the group for all of its nodes. A task
keeps the scores of a query block from one vector block to the next, so later blocks are pruned harder.
The best of each task meet in a ranking per query, cut to k rows before the shuffle.

Ties go to the smaller id; pairs are pruned only when strictly below, so no tie is lost. Bounds are
floating-point with a margin of one part in 10**9. Pivots, blocks and seeds decide what is moved, never the result.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; an empty vector
is a vector of zeros; shorter vectors are filled up with zeros; rows of one id are rows like others, though none is a
candidate of a query of its id, and queries of one id share a ranking; a null id takes no part; scores must fit 64 bits; with fewer than k candidates all are returned; empty tables give an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.llm.text import ship_package
from medledger.session import cut_lineage

SCALE, TOP = 1024, 10
BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows of the coarse top level at most; vector blocks that a task searches for one query block.
PIVOTS, TOGETHER = 256, 32
BASE = 1.3
LEAF = 48
#: Queries are searched in groups of neighbours of about so many rows.
GROUP = 128
#: Scores computed in one step, best bounds first.
DIRECT = 1 << 17


#: The score of no vector.
NOTHING = np.iinfo(np.int64).min


class Tree:
    """A cover tree over integer rows. Nodes are arrays; a node's rows and children are contiguous."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        x = rows.astype(np.float64)
        order: list[np.ndarray] = []
        centre, radius, begin, end, child, child_end = [], [], [], [], [], []

        def node(at: np.ndarray, distance: np.ndarray) -> int:
            for column, value in zip((centre, radius, begin, end, child, child_end), (at[0], float(distance.max(initial=0.0)), 0, 0, 0, 0), strict=True):
                column.append(value)
            return len(centre) - 1

        root = np.arange(len(x))
        todo = []
        if len(x):
            todo = [(node(root, np.linalg.norm(x - x[0], axis=1)), root)]
        place = 0
        # Depth first, so that the rows below a node are contiguous.
        while todo:
            n, at = todo.pop()
            if at is None:  # all below n is laid out
                end[n] = place
                continue
            begin[n] = place
            if len(at) <= LEAF or radius[n] == 0:
                order.append(at)
                place += len(at)
                end[n] = place
                continue
            parts = []
            near = radius[n] / BASE
            while len(at):
                distance = np.linalg.norm(x[at] - x[at[0]], axis=1)
                inside = distance <= near
                parts.append((at[inside], distance[inside]))
                at = at[~inside]
            child[n] = len(centre)
            made = [(node(a, d), a) for a, d in parts]
            child_end[n] = len(centre)
            todo.append((n, None))
            todo.extend(reversed(made))
        order_all = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.rows = ids[order_all], rows[order_all]
        self.centre, self.radius = x[np.array(centre, np.int64)], np.array(radius)
        self.norm = np.linalg.norm(self.centre, axis=1) if centre else np.zeros(0)
        self.begin, self.end = np.array(begin), np.array(end)
        self.child, self.child_end = np.array(child), np.array(child_end)


    def __getstate__(self) -> dict:
        """Integers travel in the narrowest type that holds them; centres are rows."""
        most = int(np.abs(self.rows).max(initial=0))
        kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        return self.__dict__ | {"rows": self.rows.astype(kind), "centre": self.centre.astype(kind)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"rows": state["rows"].astype(np.int64), "centre": state["centre"].astype(np.float64)})


class Best:
    """The best k of every query of a block so far, by falling score, then rising id."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.score = np.full((queries, k), NOTHING)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.least = np.full(queries, NOTHING) if least is None else least  # lower scores are beaten elsewhere

    def worst(self, at: slice) -> np.ndarray:
        """The score that each query's next candidate must reach."""
        return np.maximum(self.score[at, -1], self.least[at])

    def offer(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.where(score >= self.least[at, None], score, NOTHING)
        worth = ((score >= self.score[at, -1:]) & (score > NOTHING)).any(axis=0)
        if not worth.any():
            return
        score = np.concatenate([self.score[at], score[:, worth]], axis=1)
        ids = np.concatenate([self.id[at], np.broadcast_to(ids[worth], (len(score), int(worth.sum())))], axis=1)
        order = np.lexsort((ids, ~score), axis=1)[:, :k]
        self.score[at] = np.take_along_axis(score, order, axis=1)
        self.id[at] = np.take_along_axis(ids, order, axis=1)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where that is exact, else in integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products beyond 64 bits; take a smaller scale")
    return a @ b.T


def search(q: Tree, r: Tree, best: Best) -> int:
    """Improve ``best`` by the rows of ``r``; returns how many scores were computed."""
    if not len(q.ids) or not len(r.ids):
        return 0
    return _visit(q, np.zeros(1, np.int64), r, np.zeros(1, np.int64), best)


def _bounds(q: Tree, a: np.ndarray, r: Tree, b: np.ndarray) -> np.ndarray:
    """For each vector node of ``b``, no less than any score with a row of the query nodes ``a``."""
    centre = q.centre[a] @ r.centre[b].T
    reach = np.outer(q.radius[a], r.norm[b] + r.radius[b]) + np.outer(q.norm[a], r.radius[b])
    return (centre + reach + 1e-9 * (np.abs(centre) + reach + 1)).max(axis=0)


def _open(r: Tree, b: np.ndarray) -> np.ndarray:
    """The children of the nodes, and the nodes that have none."""
    inner = b[r.child_end[b] > 0]
    return np.concatenate([b[r.child_end[b] == 0], *(np.arange(r.child[n], r.child_end[n]) for n in inner)])


def _groups(q: Tree, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """Neighbouring siblings together, up to ``GROUP`` rows; a larger node alone."""
    first = 0
    for i in range(1, len(nodes) + 1):
        if i == len(nodes) or q.end[nodes[i]] - q.begin[nodes[first]] > GROUP:
            yield nodes[first:i]
            first = i


def _visit(q: Tree, a: np.ndarray, r: Tree, b: np.ndarray, best: Best) -> int:
    """Search the vector nodes ``b`` for the sibling query nodes ``a``, whose rows are contiguous."""
    rows = slice(q.begin[a[0]], q.end[a[-1]])
    b = b[_bounds(q, a, r, b) >= best.worst(rows).min()]
    if not len(b):
        return 0
    inner = (q.child_end[a] > 0).any()
    if rows.stop - rows.start > GROUP and (len(a) > 1 or inner):
        # Descend on both sides: smaller groups of queries, and the children of what is left.
        nodes = a if len(a) > 1 else np.arange(q.child[a[0]], q.child_end[a[0]])
        below = _open(r, b)
        return sum(_visit(q, part, r, below, best) for part in _groups(q, nodes))
    scored, queries = 0, q.rows[rows]
    heap = [(-x, int(n)) for x, n in zip(_bounds(q, a, r, b).tolist(), b, strict=True)]
    heapq.heapify(heap)
    width = max(256, DIRECT // len(queries))
    while heap and -heap[0][0] >= best.worst(rows).min():
        # The best nodes together, until their children or rows fill a step.
        taken, size = [], 0
        while heap and size < width:
            taken.append(heapq.heappop(heap)[1])
            size += r.end[taken[-1]] - r.begin[taken[-1]]
        nodes = _open(r, np.array(taken))
        bound = _bounds(q, a, r, nodes)
        wide = (r.end[nodes] - r.begin[nodes] > LEAF) & (r.child_end[nodes] > 0)
        for x, n in zip(bound[wide].tolist(), nodes[wide].tolist(), strict=True):
            heapq.heappush(heap, (-x, n))
        nodes, bound = nodes[~wide], bound[~wide]
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        while len(nodes):
            live = bound >= best.worst(rows).min()
            nodes, bound = nodes[live], bound[live]
            count = np.cumsum(r.end[nodes] - r.begin[nodes])
            now = max(1, int(np.searchsorted(count, width, side="right"))) if len(nodes) else 0
            at = np.concatenate([np.arange(r.begin[n], r.end[n]) for n in nodes[:now]]) if now else np.zeros(0, np.int64)
            nodes, bound = nodes[now:], bound[now:]
            if len(at):
                found = _multiply(queries, r.rows[at])
                found[q.ids[rows, None] == r.ids[at][None, :]] = NOTHING
                best.offer(rows, found, r.ids[at])
                scored += found.size
    return scored


def _vectors(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    ids = table.column(0).to_numpy()
    lists = table.column(1).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    wide = max(1, int(size.max(initial=0)))
    rows = np.zeros((len(ids), wide), np.int64)
    rows[np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return ids, rows


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cover tree of every block (rows come sorted by block), with its summary."""
    held: list[pa.RecordBatch] = []

    def grown() -> pa.RecordBatch:
        tree = Tree(*_vectors(held))
        columns = [pa.array([held[0].column(2)[0].as_py()], pa.int32()), pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())),
                   pa.array([tree.radius[0]], pa.float64()), pa.array([pickle.dumps(tree, protocol=5)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "centre", "radius", "tree"])

    for batch in batches:
        blocks = batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and a < b and held[0].column(2)[0].as_py() != blocks[a]:
                yield grown()
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield grown()


def _nearest(pivots: np.ndarray):
    """The nearest pivot of each vector, in floating point: it only decides in which block the vector is."""
    norms = (pivots.astype(np.float64) ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, rows = _vectors([batch])
                wide = min(rows.shape[1], pivots.shape[1])
                away = norms - 2 * (rows[:, :wide].astype(np.float64) @ pivots[:, :wide].T.astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1).astype(np.int32))], names=["vec_id", "v", "pivot"])

    return run


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which neighbours are near: always on to the nearest one left."""
    left, order = list(range(1, len(pivots))), [0]
    while left:
        away = ((pivots[left] - pivots[order[-1]]).astype(np.float64) ** 2).sum(axis=1)
        order.append(left.pop(int(away.argmin())))
    return pivots[order]


def _planted(rows: DataFrame, size: int, merge: bool) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The trees of blocks of about ``size`` rows of one pivot; and each pivot's first block and number of blocks.

    With ``merge``, neighbouring pivots of few rows share a block.
    """
    counts = {r["pivot"]: r["n"] for r in rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    first, at, filled = [], 0, size  # filled: rows of the last block so far
    for pivot in range(max(counts, default=-1) + 1):
        n = counts.get(pivot, 0)
        if merge and filled + n <= size:
            first.append((at - 1, int(n > 0)))
            filled += n
            continue
        parts = -(-n // size)
        first.append((at, parts))
        at, filled = at + parts, n if parts == 1 else filled if not n else size
    place = rows.sparkSession.createDataFrame([(p, a, n) for p, (a, n) in enumerate(first) if n], "pivot int, first int, parts int")
    dealt = rows.join(F.broadcast(place), "pivot").select(
        "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", "row"), F.col("parts"))).cast("int").alias("block"))
    trees = dealt.repartitionById(max(1, at), F.col("block")).sortWithinPartitions("block").mapInArrow(
        _grow, "block int, centre array<double>, radius double, tree binary")
    return cut_lineage(trees), first


def _same_width(a: Tree, b: Tree) -> None:
    wide = max(a.rows.shape[1], b.rows.shape[1])
    for t in (a, b):
        more = ((0, 0), (0, wide - t.rows.shape[1]))
        t.rows, t.centre = np.pad(t.rows, more), np.pad(t.centre, more)


def quantised(vector: Column, scale: int) -> Column:
    """Integer components; null where the vector cannot take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every row that ``queries`` (a condition on
    the column ``vec_id``) picks, among all rows but its own."""
    spark = vectors.sparkSession
    ship_package(spark)
    ready = cut_lineage(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v")).dropna())
    total = ready.count()
    picked = ready.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(PIVOTS, max(1, -(-total // block)))).collect()
    pivots = np.zeros((max(1, len(picked)), max([1, *(len(r["v"]) for r in picked)])), np.int64)
    for at, r in enumerate(picked):
        pivots[at, : len(r["v"])] = r["v"]
    pivots = _chain(pivots)
    near = cut_lineage(ready.mapInArrow(_nearest(pivots), "vec_id long, v array<bigint>, pivot int").withColumn("row", F.monotonically_increasing_id()))
    trees, first = _planted(near, block, False)
    query_trees, query_first = _planted(near.where(queries), query_block, True)
    query_trees = query_trees.toDF("q", "q_centre", "q_radius", "query_tree")

    # Every query block and one vector block of its pivot.
    seeds = list({q + at: (q + at, start + at % parts) for (q, n), (start, parts) in zip(query_first, first, strict=False) for at in range(n)}.values())
    seed = spark.createDataFrame(seeds, "q int, block int")  # one row a query block
    start = query_trees.join(seed, "q").join(trees.select("block", "tree"), "block").select("q", "query_tree", "tree")
    held = cut_lineage(start.mapInArrow(_searcher(k, True), f"q int, floor long, least binary, {_FOUND}"))

    least = held.where("least IS NOT NULL").select("q", "floor", "least")
    ask = query_trees.join(least, "q")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda total, x: total + x * x))
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda total, x: total + x)
    reach = F.col("q_radius") * (F.col("norm") + F.col("radius")) + F.col("q_norm") * F.col("radius")
    bound = dot + reach + 1e-9 * (F.abs(dot) + reach + 1)
    # Summaries against summaries: a few hundred bytes for each pair of blocks, no vectors.
    brief = trees.select("block", "centre", "radius", norm(F.col("centre")).alias("norm")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(seeds) - 1)))))
    pairs = brief.join(ask.select("q", "q_centre", "q_radius", "floor", norm(F.col("q_centre")).alias("q_norm")), "q").where(bound >= F.col("floor"))
    pairs = pairs.select("q", "block").join(seed, ["q", "block"], "left_anti")
    moved = pairs.join(trees.select("block", "tree"), "block").join(ask.select("q", "query_tree", "least"), "q")
    moved = moved.repartition("q", (F.col("block") / TOGETHER).cast("int")).sortWithinPartitions("q", "block")
    found = moved.select("q", "query_tree", "tree", "least").mapInArrow(_searcher(k, False), f"q int, floor long, least binary, {_FOUND}")
    both = held.where("least IS NULL").unionByName(found).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_FOUND = "query_id long, vec_id long, score long"


def _searcher(k: int, seeding: bool):
    """Searches the vector trees of rows (q, query tree, vector tree[, scores to beat]) and gives what each query block
    finds; when seeding, also a row with the scores to beat from then on and their minimum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, best = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                q, query_tree, other, *least = (c[row].as_py() for c in batch.columns)
                if q != now:
                    if best is not None:
                        yield from _results(now, tree, best, seeding)
                    now, tree = q, pickle.loads(query_tree)
                    best = Best(len(tree.ids), k, np.frombuffer(least[0], np.int64) if least else None)
                grown = pickle.loads(other)
                _same_width(tree, grown)
                search(tree, grown, best)
        if best is not None:
            yield from _results(now, tree, best, seeding)

    return run


def _results(q: int, tree: Tree, best: Best, seeding: bool) -> Iterator[pa.RecordBatch]:
    names = ["q", "floor", "least", "query_id", "vec_id", "score"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    if seeding:
        least = best.worst(slice(None))
        row = (q, int(least.min()), least.tobytes(), None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)
    real = best.score > NOTHING
    query, n = np.broadcast_to(tree.ids[:, None], best.id.shape)[real], int(real.sum())
    yield pa.RecordBatch.from_arrays([pa.array([q] * n, kinds[0]), *(pa.nulls(n, kind) for kind in kinds[1:3]),
                                      pa.array(query), pa.array(best.id[real]), pa.array(best.score[real])], names=names)
