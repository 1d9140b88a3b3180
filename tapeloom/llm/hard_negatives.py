"""Hard-negative mining: exact window searches in cover trees over norm-augmented candidates."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import numbered
from tapeloom.session import materialize

#: Candidates of one tree.
SHARD = 4096
#: Rows whose anchors are searched together: a block holds at most this many anchors.
ANCHOR_ROWS = 50 * 1024
#: Ways in which the trees are dealt for one block of anchors; each way gives its best rows only.
WAYS = 16
POSITIVES, NEGATIVES = 5, 3
#: A negative's score over the positive's, in hundredths.
LOW, HIGH = 50, 95
SCALE = 256
#: Covering radii shrink by this factor from level to level.
SHRINK = 0.8
#: Nodes of at most so many candidates are not split, nor those whose children would hold fewer than FEWEST on average; so many
#: nodes are opened at once.
LEAF, FEWEST, OPEN = 48, 8, 8
#: Sums of products below this are exact in doubles; beyond, whole numbers of any size are used.
_EXACT = 2.0**52
_LAST = (1 << 63) - 1


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component, held to 64 bits."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column, label: Column) -> Column:
    """False for a null label or vector, and for a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(rows: list) -> np.ndarray:
    """Whole numbers as rows of one length; shorter vectors are filled with 0."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), max(width, 1)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class CoverTree:
    """Nodes over runs of reordered candidates: a centre, the radius that covers all below, children.

    Vectors get one more component sqrt(M - |x|^2), M the largest squared norm, so that all have one length and the inner
    product with a query falls as the distance to it grows: q.x = (|q|^2 + M - dist^2) / 2. Children of a
    node are picked greedily: centres are farther apart than the level's radius, every candidate lies within it of its
    centre. Copies of one vector are one leaf, whatever their number.
    """

    def __init__(self, points: np.ndarray) -> None:
        x = points.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        self.most = float(norms.max(initial=0.0))
        full = np.column_stack([x, np.sqrt(np.maximum(self.most - norms, 0.0))])
        m = len(points)
        self.order = np.arange(m)
        start, end, centre, radius, child, children = [0], [m], [0], [0.0], [0], [0]
        away = np.sqrt(((full - full[:1]) ** 2).sum(1)) if m else np.zeros(0)
        radius[0] = float(away.max(initial=0.0))
        level = [radius[0] * SHRINK]
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            if b - a > LEAF and radius[at] > 0:
                members, reach = self.order[a:b], level[at]
                groups = []
                pick, left = centre[at], members
                while len(left) and len(groups) * FEWEST <= b - a:
                    dist = np.sqrt(((full[left] - full[pick]) ** 2).sum(1))
                    near = dist <= reach
                    near[left == pick] = True
                    groups.append((pick, left[near], float(dist[near].max(initial=0.0))))
                    left = left[~near]
                    pick = left[0] if len(left) else -1
                if len(left):  # nearly every candidate would be a node of its own: nothing to skip, so it stays a leaf
                    groups = []
                child[at], children[at] = len(start), len(groups)
                for pick, own, r in groups:
                    self.order[a : a + len(own)] = own
                    start.append(a)
                    a += len(own)
                    end.append(a)
                    centre.append(pick)
                    radius.append(r)
                    level.append(min(r, reach) * SHRINK)
                    child.append(0)
                    children.append(0)
            at += 1
        self.start, self.end, self.radius, self.child, self.children = (np.array(v) for v in (start, end, radius, child, children))
        place = np.empty(m, np.int64)
        place[self.order] = np.arange(m)
        self.centre = place[np.array(centre)]


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score downwards, then id, then row."""
    if len(score) > 4 * k:  # all that can be among them
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((rows[some], ids[some], -score[some]))[:k]]
    return np.lexsort((rows, ids, -score))[:k]


class Search:
    """Best rows of one tree for queries, each with windows of scores."""

    def __init__(self, tree: dict) -> None:
        points = np.frombuffer(tree["points"], tree["kind"]).reshape(tree["size"], -1).astype(np.int64)
        get = lambda k, t: np.frombuffer(tree[k], t)
        self.ids, self.labels, self.rows = get("ids", np.int64), get("labels", np.int64), get("rows", np.int64)
        self.start, self.end, self.radius = get("start", np.int64), get("end", np.int64), get("radius", np.float64)
        self.child, self.children, self.most = get("child", np.int64), get("children", np.int64), tree["most"]
        self.points, self.width = points, points.shape[1]
        self.norm = float(np.sqrt((points.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        self.real = points.astype(np.float64)
        self.centres = self.real[get("centre", np.int64)]

    def bounds(self, q: np.ndarray, square: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that any candidate below the nodes can have."""
        c = self.centres[nodes]
        dist = np.sqrt(np.maximum(square + self.most - 2.0 * (c @ q), 0.0))
        total = square + self.most
        slack = 1e-9 * total + 1e-6
        r = self.radius[nodes]
        high = (total - np.maximum(dist - r, 0.0) ** 2) / 2 + slack
        low = (total - (dist + r) ** 2) / 2 - slack
        return low, high

    def scores(self, exact: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.norm * float(np.sqrt(q @ q)) < _EXACT:
            return np.rint(self.real[at] @ q).astype(np.int64)
        wide = self.points[at].astype(object) @ exact.astype(object)
        return np.array([max(-_LAST, min(_LAST, v)) for v in wide], np.int64)

    def __call__(self, vector: np.ndarray, row: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int, found: list) -> list:
        """``found``: by window (scores, ids, rows), the best k so far; the best k with this tree's.

        Windows hold both ends. Nodes are opened by their largest possible score, a few at once; a node is
        left out where no window can take anything from it any more. ``same`` asks for rows of ``label``, else for the others.
        """
        vector = _fit(vector[None], self.width)[0]
        q = vector[: self.width].astype(np.float64)
        square = float((vector.astype(np.float64) ** 2).sum())
        floor = np.array([max(float(lo), float(f[0][k - 1]) if len(f[0]) >= k else -np.inf) for lo, f in zip(low, found)])
        floor[low > high] = np.inf  # an empty window
        top = high.astype(np.float64)

        def useful(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            return ((most[:, None] >= floor) & (least[:, None] <= top)).any(1)

        best = float(top.max())
        heap: list[tuple[float, int, float, float]] = []

        def push(nodes: np.ndarray) -> None:
            least, most = self.bounds(q, square, nodes)
            for i in np.flatnonzero(useful(least, most)).tolist():
                heapq.heappush(heap, (-min(float(most[i]), best), int(nodes[i]), float(least[i]), float(most[i])))

        push(np.zeros(1, np.int64))
        while heap:
            nodes = [heapq.heappop(heap) for _ in range(min(OPEN, len(heap)))]
            keep = useful(np.array([x[2] for x in nodes]), np.array([x[3] for x in nodes]))
            leaves = []
            for (_, node, _, _), yes in zip(nodes, keep):
                if not yes:
                    continue
                if self.children[node]:
                    push(np.arange(self.child[node], self.child[node] + self.children[node]))
                else:
                    leaves.append(np.arange(self.start[node], self.end[node]))
            if not leaves:
                continue
            at = np.concatenate(leaves)
            at = at[(self.labels[at] == label) == same]
            at = at[self.rows[at] != row]
            if not len(at):
                continue
            score = self.scores(vector[: self.width], q, at)
            for w in range(len(found)):
                fits = np.flatnonzero((score >= floor[w]) & (score <= high[w]))
                if len(fits):
                    new = [np.concatenate([old, x[at[fits]] if x is not None else score[fits]]) for old, x in zip(found[w], (None, self.ids, self.rows))]
                    pick = _best(*new, k)
                    found[w] = tuple(x[pick] for x in new)
                    if len(pick) >= k:
                        floor[w] = max(floor[w], float(found[w][0][k - 1]))
        return found


_TREE = "shard long, size int, most double, kind string, points binary, ids binary, labels binary, rows binary, start binary, end binary, radius binary, child binary, children binary, centre binary"


def _plant(table: pa.Table) -> pa.Table:
    """One shard's candidates (shard, row, id, label, vector) as one row: its tree."""
    table = table.sort_by("row")
    points = _matrix(table.column("vector").to_pylist())
    tree = CoverTree(points)
    take = lambda c: table.column(c).to_numpy()[tree.order].astype(np.int64).tobytes()
    small = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= points.min(initial=0) and points.max(initial=0) <= np.iinfo(k).max)
    values = {
        "shard": table.column("shard")[0].as_py(), "size": len(points), "most": tree.most, "kind": np.dtype(small).name, "points": points[tree.order].astype(small).tobytes(),
        "ids": take("id"), "labels": take("label"), "rows": take("row"), "start": tree.start.astype(np.int64).tobytes(), "end": tree.end.astype(np.int64).tobytes(),
        "radius": tree.radius.astype(np.float64).tobytes(), "child": tree.child.astype(np.int64).tobytes(), "children": tree.children.astype(np.int64).tobytes(), "centre": tree.centre.astype(np.int64).tobytes()}
    kinds = {"shard": pa.int64(), "size": pa.int32(), "most": pa.float64(), "kind": pa.string()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in values.items()})


def candidates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, vector, shard, block) of the rows that take part, numbered by label and id, written.

    ``vector`` holds whole numbers. A null id is the last among ties.
    """
    plain = rows.select(F.col(vec_id).alias("given"), F.coalesce(F.col(vec_id).cast("long"), F.lit(_LAST)).alias("id"), F.col(label).cast("long").alias("label"), quantized(F.col(vector)).alias("vector"),
                        usable(F.col(vector), F.col(label)).alias("ok")).where("ok").drop("ok").withColumn("lot", F.monotonically_increasing_id())
    placed = numbered(plain, [], ["label", "id", "lot"]).withColumnRenamed("at", "row").drop("n", "lot")
    return materialize(placed.withColumns({"shard": F.floor(F.col("row") / SHARD).cast("long"), "block": F.floor(F.col("row") / ANCHOR_ROWS).cast("long")}), "candidates")


def plant(found: DataFrame) -> DataFrame:
    """Written trees, one row per shard of at most SHARD candidates."""
    return materialize(found.select("shard", "row", "id", "label", "vector").groupBy("shard").applyInArrow(_plant, _TREE), "trees")


def search(anchors: DataFrame, trees: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, window, score, id, row): for each anchor and window the best k rows over the trees of its pairs.

    ``anchors``: row, block, label, vector, low, high (arrays of window ends). ``pairs``: (block, shard) to be met.
    A block's trees are dealt over WAYS tasks, each of which streams them past the block's anchors, one
    tree at a time, and returns its best k; these few rows are ranked at the end. So what is shuffled and returned is in
    proportion to anchors and to trees times blocks, and memory is one block and one tree.
    """
    way = F.pmod(F.xxhash64("shard"), F.lit(WAYS)).cast("int")
    pairs = pairs.withColumn("way", way)
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in trees.schema}
    blank = {c: F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in ("row", "label", "vector", "low", "high")}
    ask = anchors.join(pairs.select("block", "way").distinct(), "block").select("block", "way", F.lit(0).alias("side"), *blank, *empty.values())
    tree = pairs.join(trees, "shard").select("block", "way", F.lit(1).alias("side"), *blank.values(), *trees.columns)
    dealt = ask.unionByName(tree).repartition("block", "way").sortWithinPartitions("block", "way", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, found = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            for (row, *_), windows in zip(asked, found):
                for w, (score, ids, rows) in enumerate(windows):
                    if len(score):
                        n = len(score)
                        yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([w] * n, pa.int32()), pa.array(score), pa.array(ids), pa.array(rows)], names=["anchor", "window", "score", "id", "row"])

        for batch in batches:
            places = list(zip(batch.column("block").to_pylist(), batch.column("way").to_pylist(), batch.column("side").to_pylist()))
            for i, (block, way, side) in enumerate(places):
                if (block, way) != here:
                    yield from _merged(close())
                    here, asked, found = (block, way), [], []
                if side == 0:
                    row, label, vector, low, high = (batch.column(c)[i].as_py() for c in ("row", "label", "vector", "low", "high"))
                    asked.append((row, label, np.array(vector or [0], np.int64), np.array(low, np.int64), np.array(high, np.int64)))
                    nothing = (np.empty(0, np.int64),) * 3
                    found.append([nothing] * len(low))
                    continue
                look = Search({f: batch.column(f)[i].as_py() for f in trees_names})
                for a, (row, label, vector, low, high) in enumerate(asked):
                    found[a] = look(vector, row, label, same, low, high, k, found[a])
        yield from _merged(close())

    trees_names = trees.columns
    best = dealt.mapInArrow(run, "anchor long, window int, score long, id long, row long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merged(parts: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held = []
    for p in parts:
        held.append(p)
        if len(held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mine(rows: DataFrame, anchor: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchor``: from the id to a condition that picks the anchors; a null id is no anchor. A row's score is the inner product of
    floor(256 x) with the anchor's, in whole numbers; higher scores come first, ties by smaller id, a null id last (rows that tie in
    both: by their place). Positives are the first ``positives`` other rows of the anchor's label. For each of
    them, the first ``negatives`` rows of another label with ``low`` * positive <= 100 * score <= ``high`` * positive. Rows without
    a label or vector, or with a null or non-finite component, take no part. Missing components of a shorter vector
    count as 0. Rows that repeat are rows of their own. Components are held to 64 bits, scores too. An empty table, or one
    without anchors, gives no rows; extra columns are left out.

    Candidates are numbered by label and cut into shards, each with a cover tree; a hot label is many shards. Blocks of
    anchors meet every shard (for positives: those with one of their labels), as a stated query set against all rows.
    """
    found = candidates(rows, vec_id, vector, label)
    trees = plant(found)
    asks = found.where(F.coalesce(anchor(F.col("given")), F.lit(False)))
    asks = materialize(asks.select("row", "block", "label", "vector", F.col("given").alias("anchor_id")), "anchors")
    where = found.select("label", "shard").distinct()
    near = asks.select("label", "block").distinct().join(where, "label").select("block", "shard").distinct()
    least, most = F.array(F.lit(-_LAST)), F.array(F.lit(_LAST))
    ids = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    best = search(asks.withColumns({"low": least, "high": most}), trees, near, positives, True)
    best = materialize(best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")

    # the window in whole numbers: ceil(low * p / 100) to floor(high * p / 100)
    p = F.col("positive_score").cast("decimal(38,0)")
    from_, to = F.ceil(p * low / 100).cast("long"), F.floor(p * high / 100).cast("long")
    windows = F.sort_array(F.collect_list(F.struct("place", from_.alias("low"), to.alias("high"))))
    wide = best.groupBy("anchor").agg(windows.alias("x")).select(F.col("anchor").alias("row"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    count = (found.agg(F.max("row")).first()[0] or 0) + 1
    every = rows.sparkSession.range(-(-count // SHARD)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // ANCHOR_ROWS).cast("long"))).alias("block"), F.col("id").alias("shard"))
    every = every.join(asks.select("block").distinct(), "block", "left_semi")
    worst = search(asks.join(wide, "row"), trees, every, negatives, False)
    out = worst.withColumn("place", F.col("window") + 1).join(best, ["anchor", "place"]).join(asks.select(F.col("row").alias("anchor"), "anchor_id"), "anchor")
    return out.select("anchor_id", ids("positive").alias("positive_id"), "rank", ids("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
