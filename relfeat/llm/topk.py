"""Exact top-k by inner product with cover trees over queries and data.

The tree's top level is laid by Spark: pivots, as far apart as a bounded sample allows, part all rows into cells, and a cell's
rows, by their distance from its pivot, into blocks. Below, each block has a cover tree: a node's covering radius bounds how
far its points lie from its centre, and centres of siblings lie at least as far apart as each covers. Queries are cut into
blocks and indexed alike. For query centre q of radius s and data centre c of radius r no pair scores above
<q, c> + s |c| + r |q| + r s; a pair of blocks or nodes below the worst kth score of its query group is dropped whole. Before
blocks meet, each query has a kth score already, from the sample's rows; pairs of blocks that can't reach it are never sent.

Scores are exact: by doubles, 64-bit integers or Python integers, whichever the lengths of two vectors call for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relfeat.llm.common import materialize, partitions

#: Vectors of a data block and of a query block at most.
DATA_BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows that the pivots and the first kth scores are drawn from, and pivots of each length of vector, at most. They decide
#: how much is pruned, never what is found.
SAMPLE, PIVOTS = 4096, 64
#: Query blocks that one task holds beside a data block.
_TOGETHER = 32
#: Scores stay within this; what lies beyond counts as it. The number below stands for no score.
MOST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
#: Points of a leaf at most, and children of a node at most.
_LEAF, _FAN = 128, 16


class Node:
    __slots__ = ("centre", "children", "high", "low", "norm", "radius")

    def __init__(self, low: int, high: int, centre: np.ndarray, radius: float) -> None:
        self.low, self.high, self.centre, self.radius, self.children = low, high, centre, radius, ()
        self.norm = float(np.sqrt(centre @ centre))


class CoverTree:
    """A cover tree over the rows of x, which it puts in order so that each node's points are a range."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.x = x.astype(np.float64)
        self.root = self._build(0, len(x))

    def _build(self, low: int, high: int) -> Node:
        part = self.x[low:high]
        centre = part[0]
        far = np.sqrt(((part - centre) ** 2).sum(1))
        node = Node(low, high, centre, float(far.max()) if len(far) else 0.0)
        if high - low <= _LEAF:
            return node
        if not 0 < node.radius < math.inf:  # equal points, or points too far apart to tell how far
            middle = (low + high) // 2
            node.children = (self._build(low, middle), self._build(middle, high))
            return node
        # Farthest-first centres: each new one is as far from the others as any point is, which separates siblings by
        # what the last one covers.
        near, owner, n = far, np.zeros(high - low, np.int64), 1
        while n < _FAN and (top := int(near.argmax())) >= 0 and near[top] > node.radius / 2:
            gap = np.sqrt(((part - part[top]) ** 2).sum(1))
            closer = gap < near
            near, owner = np.where(closer, gap, near), np.where(closer, n, owner)
            n += 1
        if n == 1:
            # No point beyond half the radius: a nearer level has the same centre, so the farthest point opens it.
            top = int(near.argmax())
            gap = np.sqrt(((part - part[top]) ** 2).sum(1))
            owner, n = (gap < near).astype(np.int64), 2
        # A child's centre comes first in its range.
        order = np.lexsort((near, owner))
        self.order[low:high], self.x[low:high] = self.order[low:high][order], part[order]
        ends = low + np.searchsorted(owner[order], np.arange(n + 1))
        node.children = tuple(self._build(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b)
        return node


class Best:
    """The k best of each query so far: higher scores first, ties to smaller ids. floor: what a query's kth score is at least."""

    def __init__(self, rows: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.rows, self.floor = rows, floor
        self.scores = np.full((len(rows), k), NONE)
        self.ids = np.full((len(rows), k), MOST)
        self.found = np.full((len(rows), k), -1)

    def worst(self, low: int, high: int) -> np.ndarray:
        return np.maximum(self.scores[low:high, -1], self.floor[low:high])

    def add(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = np.where(rows[None, :] == self.rows[low:high, None], NONE, scores)
        alive = np.flatnonzero((scores >= self.worst(low, high)[:, None]).any(0))
        if not len(alive):
            return
        n, k = high - low, self.scores.shape[1]
        old, new = (self.scores, self.ids, self.found), (scores[:, alive], np.broadcast_to(ids[alive], (n, len(alive))), np.broadcast_to(rows[alive], (n, len(alive))))
        scores, ids, rows = (np.concatenate([a[low:high], b], 1) for a, b in zip(old, new, strict=True))
        rows[scores == NONE] = -1
        order = np.lexsort((rows, ids, ~scores), axis=1)[:, :k]  # ~ turns the order of integers round
        for a, b in zip(old, (scores, ids, rows), strict=True):
            a[low:high] = np.take_along_axis(b, order, 1)


def inner(a: np.ndarray, b: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, within MOST. long_a and long_b: the rows' lengths."""
    most = long_a.max(initial=0) * long_b.max(initial=0)
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.empty((len(a), len(b)), np.int64)
    large_a, large_b = long_a >= 2.0**30.5, long_b >= 2.0**30.5
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    few = whole(b[large_b]).T
    for rows, cols, there in ((large_a, ~large_b, whole(b[~large_b]).T), (large_a, large_b, few), (~large_a, large_b, few)):
        if rows.any() and cols.any():
            exact = whole(a[rows]).dot(there)
            out[np.ix_(rows, cols)] = np.clip(exact, -MOST, MOST).astype(np.int64)
    if (~large_a).any() and (~large_b).any():
        out[np.ix_(~large_a, ~large_b)] = inner(a[~large_a], b[~large_b], long_a[~large_a], long_b[~large_b])
    return out


class Block:
    """Rows (row: a name of their own, id, whole-number vector) under a cover tree."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.tree = CoverTree(vectors)
        self.rows, self.ids = rows[self.tree.order], ids[self.tree.order]
        self.lengths = np.sqrt((self.tree.x**2).sum(1))


def search(queries: Block, data: Block, floor: np.ndarray, k: int) -> Best:
    """The k best rows of data for each row of queries (in the order of its tree), the row itself left out.

    floor: a score for each query that its kth best row, somewhere, is known to reach; rows below it may be left out.
    """
    q, d = queries.tree, data.tree
    best = Best(queries.rows, floor[q.order], k)
    todo = [(q.root, d.root, math.inf)]
    while todo:
        a, b, most = todo.pop()
        if most < best.worst(a.low, a.high).min():  # equal scores may win by their id
            continue
        if not a.children and not b.children:
            some, those = slice(a.low, a.high), slice(b.low, b.high)
            best.add(a.low, a.high, inner(q.x[some], d.x[those], queries.lengths[some], data.lengths[those]), data.ids[those], data.rows[those])
            continue
        down_a = a.children and (not b.children or a.radius >= b.radius)
        pairs = [(x, b) for x in a.children] if down_a else [(a, y) for y in b.children]
        # The most promising pair is popped first and raises the bar for the others.
        todo += sorted(((x, y, bound(float(x.centre @ y.centre), x.radius, x.norm, y.radius, y.norm)) for x, y in pairs), key=lambda p: p[2])
    return best


def bound(dot: float, radius_a: float, norm_a: float, radius_b: float, norm_b: float) -> float:
    """What no pair of points of two nodes scores above, with room for rounding. Not a number where doubles overflow: such a
    bound is below nothing, so it prunes nothing."""
    return dot + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b + 1e-9 * (1 + norm_a + radius_a) * (1 + norm_b + radius_b)


_BLOCKS = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("asks", pa.binary()), ("vectors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64())])
_BLOCKS_SQL = "block long, width int, n int, ids binary, asks binary, vectors binary, centre array<double>, radius double, norm double"
_ASKS = pa.schema([("ask", pa.int64()), ("ask_width", pa.int32()), ("ask_rows", pa.binary()), ("ask_ids", pa.binary()), ("ask_vectors", pa.binary()), ("floor", pa.binary()), ("least", pa.int64()), ("ask_centre", pa.list_(pa.float64())), ("ask_radius", pa.float64()), ("ask_norm", pa.float64())])
_ASKS_SQL = "ask long, ask_width int, ask_rows binary, ask_ids binary, ask_vectors binary, floor binary, least long, ask_centre array<double>, ask_radius double, ask_norm double"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers where all fit, else as doubles."""
    return (b"i" + x.astype("<i4").tobytes()) if not x.size or np.abs(x).max() < 2**31 else b"d" + x.astype("<f8").tobytes()


def _unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data[1:], "<i4" if data[:1] == b"i" else "<f8").astype(np.float64).reshape(n, width)


def _ball(x: np.ndarray) -> tuple[list[float], float, float]:
    """A centre, the radius of all rows about it, and its length."""
    with np.errstate(all="ignore"):
        centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
        return centre.tolist(), float(np.sqrt(((x - centre) ** 2).sum(1)).max(initial=0)), float(np.sqrt((centre**2).sum()))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_width(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    return {width: np.stack([v for v in vectors if len(v) == width]) for width in sorted({len(v) for v in vectors})}


def pivots(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vector rows of the sample, each as far from those before as any is; PIVOTS at most."""
    out: dict[int, np.ndarray] = {}
    for width, x in _by_width(sample).items():
        with np.errstate(all="ignore"):
            chosen, near = [0], np.nan_to_num(((x - x[0]) ** 2).sum(1))
            while len(chosen) < PIVOTS and near.max() > 0:
                chosen.append(int(near.argmax()))
                near = np.minimum(near, np.nan_to_num(((x - x[chosen[-1]]) ** 2).sum(1)))
        out[width] = x[chosen]
    return out


def _cells(spread):
    """Adds to each row its length, its cell (the nearest pivot's number) and the distance from that pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            widths = np.fromiter(map(len, vectors), np.int32, len(vectors))
            cell, gap = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
            for width in np.unique(widths).tolist():
                if width not in spread.value:
                    continue
                own, at = np.flatnonzero(widths == width), spread.value[width]
                x = np.stack([vectors[i] for i in own])
                with np.errstate(all="ignore"):
                    far = np.nan_to_num((x**2).sum(1)[:, None] - 2 * x @ at.T + (at**2).sum(1), nan=0.0)
                cell[own] = far.argmin(1)
                gap[own] = np.sqrt(np.maximum(far.min(1), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "asks")), pa.array(widths), pa.array(cell), pa.array(gap)], ["vec_id", "vector", "asks", "width", "cell", "gap"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that arrive by length, cell and distance, as blocks."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def put() -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, asks, rows = (list(x) for x in zip(*held, strict=True))
        held.clear()
        x = np.stack(rows)
        centre, radius, norm = _ball(x)
        return pa.RecordBatch.from_pylist([{"block": (part << 24) + number, "width": x.shape[1], "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "asks": np.flatnonzero(asks).astype("<i4").tobytes(), "vectors": _packed(x), "centre": centre, "radius": radius, "norm": norm}], schema=_BLOCKS)

    last = None
    for batch in batches:
        rows = zip(batch.column("vec_id").to_pylist(), batch.column("asks").to_pylist(), _matrix(batch.column("vector")), batch.column("cell").to_pylist(), strict=True)
        for i, asks, x, cell in rows:
            if held and (last != (len(x), cell) or len(held) >= DATA_BLOCK):
                yield put()
            held.append((i, asks, x))
            last = (len(x), cell)
    if held:
        yield put()


def _queries(spread, k: int):
    """The rows of data blocks that ask, as query blocks: with a score each that its kth best row is known to reach, which
    the sample gives. One of the sample's rows may be the query itself, so its next best counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def put(width: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows, ids, x = (np.concatenate(y) for y in zip(*held.pop(width), strict=True))
            some, floor = spread.value.get(width, np.zeros((0, width))), np.full(len(x), NONE)
            if len(some) > k:
                scores = inner(x, some, np.sqrt((x**2).sum(1)), np.sqrt((some**2).sum(1)))
                floor = np.partition(scores, len(some) - k - 1, 1)[:, len(some) - k - 1]
            centre, radius, norm = _ball(x)
            return pa.RecordBatch.from_pylist([{"ask": (part << 24) + number, "ask_width": width, "ask_rows": rows.tobytes(), "ask_ids": ids.tobytes(), "ask_vectors": _packed(x), "floor": floor.tobytes(), "least": int(floor.min()), "ask_centre": centre, "ask_radius": radius, "ask_norm": norm}], schema=_ASKS)

        for batch in batches:
            for r in batch.to_pylist():
                at, width = np.frombuffer(r["asks"], "<i4").astype(np.int64), r["width"]
                x = _unpacked(r["vectors"], width, r["n"])
                for low in range(0, len(at), QUERY_BLOCK):
                    some = at[low : low + QUERY_BLOCK]
                    have = sum(len(y[0]) for y in held.get(width, ()))
                    if have and have + len(some) > QUERY_BLOCK:
                        yield put(width)
                    held.setdefault(width, []).append(((r["block"] << 13) + some, np.frombuffer(r["ids"], "<i8")[some], x[some]))
        for width in list(held):
            yield put(width)

    return run


def _meet(k: int):
    """Pairs that arrive by data block: a block's tree is built once, its queries' blocks come one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, data = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["ask"] is None:
                    n = r["n"]
                    block, data = r["block"], Block((r["block"] << 13) + np.arange(n), np.frombuffer(r["ids"], "<i8"), _unpacked(r["vectors"], r["width"], n))
                    continue
                assert r["block"] == block and data is not None
                rows, ids = np.frombuffer(r["ask_rows"], "<i8"), np.frombuffer(r["ask_ids"], "<i8")
                asks = Block(rows, ids, _unpacked(r["ask_vectors"], r["ask_width"], len(rows)))
                best = search(asks, data, np.frombuffer(r["floor"], "<i8"), k)
                at, place = np.nonzero(best.found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asks.rows[at], asks.ids[at], best.found[at, place], best.ids[at, place], best.scores[at, place])], ["query_row", "query_id", "row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asks: Column, spark: SparkSession, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors where asks holds, its k best rows but itself.

    vectors has vec_id and vector (doubles, floored to whole numbers). Scores are inner products, exact; beyond the range of
    a long they count as its ends. Ties go to the smaller vec_id; with fewer than k candidates all are returned. Rows without
    a vec_id or vector, or with components that are null or not finite, take no part, nor do vectors of another length than
    a query's. Rows that repeat, or share a vec_id, are rows of their own, as candidates and as queries. Empty vectors score
    0. Other columns are not carried. Empty tables give an empty result.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    head = rows.select("vector", F.xxhash64("vec_id", "vector").alias("key")).orderBy("key").limit(SAMPLE).select("vector").collect()
    sample = [np.floor(np.array(r["vector"], np.float64)) for r in head]
    by_width = _by_width(sample)
    context = spark.sparkContext
    celled = rows.mapInArrow(_floored, "vec_id long, vector array<double>, asks boolean").mapInArrow(_cells(context.broadcast(pivots(sample))), "vec_id long, vector array<double>, asks boolean, width int, cell int, gap double")
    order = ("width", "cell", "gap", "vec_id")
    data = materialize(celled.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_blocks, _BLOCKS_SQL), spark)
    queries = materialize(data.where("octet_length(asks) > 0").select("block", "width", "n", "ids", "asks", "vectors").mapInArrow(_queries(context.broadcast(by_width), k), _ASKS_SQL), spark)

    # Which blocks meet is decided on their centres and radii alone.
    dot = F.aggregate(F.zip_with("ask_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    most = bound(dot, F.col("ask_radius"), F.col("ask_norm"), F.col("radius"), F.col("norm"))
    ways, sides = data.select("block", "width", "centre", "radius", "norm"), queries.select("ask", "ask_width", "least", "ask_centre", "ask_radius", "ask_norm")
    pairs = ways.join(sides, F.col("width") == F.col("ask_width")).where(most >= F.col("least")).select("block", "ask")
    # A data block that many query blocks reach goes out several times, each with _TOGETHER of them or so.
    pairs = materialize(pairs.withColumn("group", F.pmod(F.xxhash64("ask"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("block")) / _TOGETHER)))), spark)
    met = pairs.join(queries.select("ask", "ask_width", "ask_rows", "ask_ids", "ask_vectors", "floor"), "ask")
    sent = pairs.select("block", "group").distinct().join(data.select("block", "width", "n", "ids", "vectors"), "block")
    both = sent.unionByName(met, allowMissingColumns=True).repartition(partitions(spark), "block", "group").sortWithinPartitions("block", "group", F.col("ask").asc_nulls_first())
    found = both.mapInArrow(_meet(k), "query_row long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        flat = pa.array(np.floor(column.values.to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(column.offsets, flat), batch.column("asks")], ["vec_id", "vector", "asks"])


def op6_topk_search(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Components x become floor(1024 x); one whose product passes the range of doubles counts as their largest."""
    largest = float(np.finfo(np.float64).max)
    grown = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) <= largest / 1024, x.cast("double") * 1024).when(F.abs(x.cast("double")) <= largest, F.signum(x.cast("double")) * largest).otherwise(x.cast("double")))
    return top_k(embeddings.select("vec_id", grown.alias("vector")), F.col("vec_id") % 100 == 0, spark)
