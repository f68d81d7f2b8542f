"""Hard negatives by best-first descent of cover trees over norm-augmented vectors.

A candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
so all candidates lie on one sphere and an inner product with a query tells the angle
to it. Nodes of a cover tree know the largest angle to any row below them (covering radius),
so score and radius of its centre bound all scores of a node from both sides. Centres of
a node are picked farthest first, which keeps them apart by at least the radius they
leave uncovered; a centre is the first centre of its own children, too. Nodes whose bounds lie
outside a query's window, or below its worst kept score, are skipped, the others
are opened in the order of their upper bounds, and rows of leaves are scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scalefold.llm.text import shipped
from scalefold.session import land

#: Rows of a tree, rows of a leaf, children of a node.
SHARD_ROWS, LEAF_ROWS, FAN = 4096, 256, 16
#: Rows the top level is fitted on, and its most cells. Every row is indexed; the sample only places the cells.
SAMPLE_ROWS, MOST_CELLS = 4096, 256
#: Searches that meet a tree at once; packs of one task.
PACK_ROWS, SLICE_PACKS = 512, 64
#: Leaves a search opens in one step.
STEP_LEAVES = 2
#: Share of |q| M by which bounds are widened: far above what arccos loses.
SLACK = 1e-6
LEAST, MOST = -(1 << 62), 1 << 62
UNPLACED = -1


class Node(NamedTuple):
    centre: int
    angle: float
    level: int
    parent: int
    begin: int
    end: int
    leaf: bool


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Unit vectors of the rows with the component that gives them all the norm ``most``."""
    x = vectors.astype(np.float64) / (most or 1.0)
    rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.column_stack([x, rest])


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def farthest_first(unit: np.ndarray, first: int, most: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, the nearest centre of each row and the angle to it; ends at ``most`` centres or a radius up to ``enough``."""
    centres = [first]
    near = np.zeros(len(unit), np.int64)
    angle = angles(unit @ unit[first])
    while len(centres) < most and angle.max() > enough:
        centres.append(int(angle.argmax()))
        other = angles(unit @ unit[centres[-1]])
        other[centres[-1]] = 0.0
        near[other < angle] = len(centres) - 1
        angle = np.minimum(angle, other)
    return np.array(centres), near, angle


def built(unit: np.ndarray) -> tuple[np.ndarray, list[Node]]:
    """Row order and nodes, level by level; a node covers ``order[begin:end]``."""
    order = np.arange(len(unit))
    nodes = [Node(0, 0.0, 0, 0, 0, len(unit), False)]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        rows = order[node.begin : node.end]
        angle = angles(unit[rows] @ unit[node.centre])
        radius = float(angle.max())
        if len(rows) <= LEAF_ROWS:
            nodes[at] = node._replace(angle=radius, leaf=True)
        else:
            nodes[at] = node._replace(angle=radius)
            if radius <= SLACK:  # equal rows: nothing to tell apart
                part = np.arange(len(rows)) // LEAF_ROWS
                centres = rows[::LEAF_ROWS]
            else:
                picked, part, _ = farthest_first(unit[rows], int(np.flatnonzero(rows == node.centre)[0]), FAN, radius / 2)
                centres = rows[picked]
            order[node.begin : node.end] = rows[np.argsort(part, kind="stable")]
            ends = node.begin + np.cumsum(np.bincount(part, minlength=len(centres)))
            begins = np.concatenate([[node.begin], ends[:-1]])
            nodes += [
                Node(int(c), 0.0, node.level + 1, at, int(b), int(e), False) for c, b, e in zip(centres, begins, ends) if e > b
            ]
        at += 1
    return order, nodes


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The smallest type in which inner products of integers are exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


class Searches(NamedTuple):
    """What is asked: vectors, own ids and labels, and for each one or more windows of scores, as columns."""

    vectors: np.ndarray
    own: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def within(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Where scores between ``least`` and ``most`` (search, node) can lie in a window."""
        out = np.zeros(least.shape, bool)
        for low, high in zip(self.low.T, self.high.T):
            out |= (most >= low[:, None]) & (least <= high[:, None])
        return out


class Found(NamedTuple):
    """Rows kept: search, window, row, score."""

    search: np.ndarray
    window: np.ndarray
    row: np.ndarray
    score: np.ndarray


class CoverTree:
    """Rows of one shard in tree order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        first = np.lexsort((labels, ids))
        order, nodes = built(lifted(vectors[first], most))
        rows = first[order]
        self.most, self.ids, self.labels, self.vectors = most, ids[rows], labels[rows], vectors[rows]
        self.nodes = nodes
        place = np.argsort(order)
        self.centre = place[[n.centre for n in nodes]]
        self.angle = np.array([n.angle for n in nodes])
        self.level, self.parent, self.begin, self.end = (np.array([n[k] for n in nodes]) for k in (2, 3, 4, 5))
        self.leaves = np.flatnonzero([n.leaf for n in nodes])
        self.label_low = np.array([self.labels[n.begin : n.end].min() for n in nodes])
        self.label_high = np.array([self.labels[n.begin : n.end].max() for n in nodes])
        # place in id order: of equal scores the smaller id comes first
        self.late = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")
        self.opened = 0

    def bounds(self, asked: Searches, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = asked.vectors.astype(np.float64)
        reach = np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)) * self.most, 1e-300)[:, None]
        to = angles(q @ self.vectors[self.centre[nodes]].astype(np.float64).T / reach)
        wide = self.angle[nodes][None, :]
        slack = SLACK * reach + 1e-6
        return reach * np.cos(np.maximum(to - wide, 0.0)) + slack, reach * np.cos(np.minimum(to + wide, np.pi)) - slack

    def search(self, asked: Searches, k: int, same: bool) -> Found:
        """The best ``k`` rows of the same or of other labels inside each window."""
        m, windows = asked.low.shape
        alive = np.zeros((m, len(self.centre)), bool)
        upper = np.full((m, len(self.centre)), -np.inf)
        label = asked.label[:, None]
        for level in range(int(self.level.max()) + 1):
            nodes = np.flatnonzero(self.level == level)
            open_ = alive[:, self.parent[nodes]] if level else np.ones((m, 1), bool)
            used = open_.any(axis=0)
            nodes, open_ = nodes[used], open_[:, used]
            if not len(nodes):
                break
            high, low = self.bounds(asked, nodes)
            if same:
                fits = (self.label_low[nodes] <= label) & (label <= self.label_high[nodes])
            else:
                fits = (self.label_low[nodes] != label) | (label != self.label_high[nodes])
            alive[:, nodes] = open_ & fits & asked.within(low, high)
            upper[:, nodes] = high
        bound = np.where(alive[:, self.leaves], upper[:, self.leaves], -np.inf)
        turn = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, turn, axis=1)
        kind = exact_kind(asked.vectors, self.vectors)
        vectors, rows = asked.vectors.astype(kind), self.vectors.astype(kind)
        cut, top = asked.low.copy(), asked.high.max(axis=1)
        kept = Found(*(np.zeros(0, np.int64),) * 4)
        live = np.arange(m)
        for at in range(0, len(self.leaves), STEP_LEAVES):
            # a leaf that ties the worst kept score may hold a smaller id
            least = cut.min(axis=1)
            live = live[bound[live, at] >= least[live]]
            if not len(live):
                break
            who, place = np.nonzero(bound[live, at : at + STEP_LEAVES] >= least[live, None])
            who, leaf = live[who], self.leaves[turn[live[who], at + place]]
            fresh = self._opened(vectors, rows, who, leaf, least, top)
            kept = self._kept(asked, kept, fresh, cut, k, same)
            full = np.bincount(kept.search * windows + kept.window, minlength=m * windows).reshape(m, windows) >= k
            worst = np.full(m * windows, MOST)
            np.minimum.at(worst, kept.search * windows + kept.window, kept.score)
            cut = np.where(full, np.maximum(cut, worst.reshape(m, windows)), cut)
        return kept

    def _opened(self, vectors, rows, who, leaf, least, top) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Searches and leaves multiplied leaf by leaf; what lies between each search's least and top score."""
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        ends = np.flatnonzero(np.diff(leaf, append=-1)) + 1
        out = [(np.zeros(0, np.int64),) * 3]
        for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            mine, node = who[begin:end], leaf[begin]
            first, last = self.begin[node], self.end[node]
            score = vectors[mine] @ rows[first:last].T
            self.opened += score.size
            q, r = np.nonzero((score >= _fitted(least[mine], score.dtype)) & (score <= _fitted(top[mine], score.dtype)))
            out.append((mine[q], first + r, score[q, r].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _kept(self, asked, kept, fresh, cut, k, same) -> Found:
        search, row, score = fresh
        real = ((self.labels[row] == asked.label[search]) == same) & (self.ids[row] != asked.own[search])
        search, row, score = search[real], row[real], score[real]
        parts = [kept]
        for w in range(cut.shape[1]):
            inside = (score >= cut[search, w]) & (score <= asked.high[search, w])
            parts.append(Found(search[inside], np.full(int(inside.sum()), w), row[inside], score[inside]))
        search, window, row, score = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((self.late[row], -score, window, search))
        search, window, row, score = search[order], window[order], row[order], score[order]
        group = search * cut.shape[1] + window
        best = np.arange(len(group)) - np.searchsorted(group, group) < k
        return Found(search[best], window[best], row[best], score[best])


def _fitted(limit: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Limits of scores in their own type; beyond what it holds exactly no score lies."""
    most = {4: 1 << 24, 8: 1 << 53}[kind.itemsize] if kind.kind == "f" else MOST
    return np.clip(limit, -most, most).astype(kind)[:, None]


class Cells:
    """The top level: centres per number of dimensions, with radius and number of trees below each."""

    def __init__(self, sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], most: float, wanted: int):
        self.most, self.sample, self.first, self.unit = most, sample, {}, {}
        self.radius, self.trees = np.zeros(0), np.zeros(0, np.int64)
        n = 0
        for dim, (_, _, vectors) in sorted(sample.items()):
            unit = lifted(vectors, most)
            picked, _, _ = farthest_first(unit, 0, max(1, min(wanted, MOST_CELLS - n)), SLACK)
            self.first[dim], self.unit[dim] = n, unit[picked]
            n += len(picked)
            if n >= MOST_CELLS:
                break
        self.radius, self.trees = np.zeros(n), np.zeros(n, np.int64)
        self.loose = 0  # trees of rows whose number of dimensions the sample lacks

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cell of each row and the angle to its centre."""
        dim = vectors.shape[1]
        if dim not in self.first:
            return np.full(len(vectors), UNPLACED), np.zeros(len(vectors))
        to = angles(lifted(vectors, self.most) @ self.unit[dim].T)
        near = to.argmin(axis=1)
        return self.first[dim] + near, to[np.arange(len(near)), near]

    def met(self, asked: Searches) -> np.ndarray:
        """Which cells of its dimensions a search has to visit: (search, cell)."""
        dim = asked.vectors.shape[1]
        q = asked.vectors.astype(np.float64)
        reach = np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)) * self.most, 1e-300)[:, None]
        first, unit = self.first[dim], self.unit[dim]
        to = angles(q @ (unit[:, :-1] * self.most).T / reach)
        wide = self.radius[first : first + len(unit)][None, :]
        slack = SLACK * reach + 1e-6
        high = reach * np.cos(np.maximum(to - wide, 0.0)) + slack
        low = reach * np.cos(np.minimum(to + wide, np.pi)) - slack
        return asked.within(low, high)

    def floor(self, asked: Searches, k: int, same: bool) -> np.ndarray:
        """Scores that the k-th best of each window reaches already among the sampled rows: a first lower bound."""
        held = self.sample.get(asked.vectors.shape[1])
        if held is None or len(held[0]) < k:
            return asked.low
        ids, labels, vectors = held
        kind = exact_kind(asked.vectors, vectors)
        score = (asked.vectors.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
        real = ((labels == asked.label[:, None]) == same) & (ids != asked.own[:, None])
        out = []
        for low, high in zip(asked.low.T, asked.high.T):
            held = np.where(real & (score >= low[:, None]) & (score <= high[:, None]), score, LEAST)
            out.append(np.maximum(low, np.partition(held, len(ids) - k, axis=1)[:, len(ids) - k]))
        return np.stack(out, axis=1)


def vectors_of(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    got = column.take(pa.array(rows))
    return np.asarray(got.flatten(), dtype=np.int64).reshape(len(rows), -1)


def by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each number of dimensions in a batch."""
    many = np.diff(np.asarray(batch.column(column).offsets, dtype=np.int64))
    for dim in np.unique(many):
        rows = np.flatnonzero(many == dim)
        yield rows, vectors_of(batch.column(column), rows)


def asked_of(batch: pa.RecordBatch, rows: np.ndarray, vectors: np.ndarray) -> Searches:
    own, label = (np.asarray(batch.column(c).take(pa.array(rows)), dtype=np.int64) for c in ("own", "label"))
    return Searches(vectors, own, label, *(vectors_of(batch.column(c), rows) for c in ("low", "high")))


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the best ``k`` of any search.

    Rows of one vector and label tie in every search, so of each such group only the rows of
    the k + 1 smallest ids matter (one of them may be the search's own), and k rows of an id.
    Limits on the rank are applied before the shuffle too, so copies never gather in one task.
    """
    repeat = F.row_number().over(W.partitionBy("vec", "label", "id").orderBy(F.lit(0)))
    rank = F.dense_rank().over(W.partitionBy("vec", "label").orderBy("id"))
    once = vectors.withColumn("_n", repeat).filter(F.col("_n") <= k)
    return once.withColumn("_n", rank).filter(F.col("_n") <= k + 1).drop("_n")


class Forest:
    """Cover trees over all rows, written as a table of one row a tree."""

    def __init__(self, rows: DataFrame, k: int):
        spark = rows.sparkSession
        rows = land(candidates(rows, k), "candidates")
        norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, square = rows.agg(F.count("*"), F.max(norm)).first()
        drawn = rows.orderBy(F.xxhash64("vec", "label", "id"), "id").limit(SAMPLE_ROWS).collect()
        sample = {}
        for dim in {len(r.vec) for r in drawn}:
            mine = [r for r in drawn if len(r.vec) == dim]
            sample[dim] = tuple(np.array([r[c] for r in mine], dtype=np.int64) for c in ("id", "label", "vec"))
        most = float(np.sqrt(square or 0.0)) * (1 + 1e-12)
        self.k, self.spark = k, spark
        self.cells = cells = Cells(sample, most, -(-n // SHARD_ROWS))
        held = shipped(spark, cells)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = held()
            for batch in batches:
                cell, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for at, vectors in by_dimension(batch, "vec"):
                    cell[at], angle[at] = top.place(vectors)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        dealt = land(rows.select("id", "label", "vec").mapInArrow(placed, "id long, label long, vec array<long>, cell long, angle double"), "placed")
        for cell, many, angle in dealt.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():  # MOST_CELLS + 1 rows at most
            if cell == UNPLACED:
                cells.loose = -(-many // SHARD_ROWS)
            else:
                cells.trees[cell], cells.radius[cell] = -(-many // SHARD_ROWS), angle
        self.held = shipped(spark, cells)
        trees = F.array(*[F.lit(int(t)) for t in cells.trees], F.lit(int(cells.loose)))
        salt = F.pmod(F.xxhash64("vec"), F.get(trees, F.when(F.col("cell") == UNPLACED, len(cells.trees)).otherwise(F.col("cell")).cast("int")))
        grouped = dealt.groupBy(F.size("vec").alias("dim"), "cell", salt.alias("salt")).agg(
            F.collect_list("id").alias("ids"), F.collect_list("label").alias("labels"), F.flatten(F.collect_list("vec")).alias("vecs")
        )
        self.trees = land(grouped, "trees")

    def best(self, searches: DataFrame, same: bool, windows: int, carry: list[str]) -> DataFrame:
        """``searches(number, own, label, low, high, vec)`` to their best k rows: ``carry``, window, found id, score, rank.

        ``low`` and ``high`` are lists of ``windows`` scores.
        """
        k, held = self.k, self.held
        names = ["number", "own", "label", "low", "high", "vec"]
        schema = "number long, own long, label long, low array<long>, high array<long>, vec array<long>"

        def listed(rows: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = held()
            for batch in batches:
                for rows, vectors in by_dimension(batch, "vec"):
                    asked = asked_of(batch, rows, vectors)
                    low = top.floor(asked, k, same)
                    dim = vectors.shape[1]
                    if dim in top.first:
                        who, cell = np.nonzero(top.met(asked._replace(low=low)))
                        cell = cell + top.first[dim]
                        many = top.trees[cell]
                    else:
                        who = np.arange(len(rows))
                        cell, many = np.full(len(rows), UNPLACED), np.full(len(rows), top.loose)
                    taken = batch.take(pa.array(rows[who]))
                    columns = [taken.column(c) if c != "low" else listed(low[who]) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cell), pa.array(many)], names=[*names, "cell", "many"])

        packs = F.ceil(F.lit(searches.count()) / PACK_ROWS).cast("long")
        sent = (
            searches.select(*names)
            .mapInArrow(routed, f"{schema}, cell long, many long")
            .filter("many > 0")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
            .withColumns({"dim": F.size("vec"), "pack": F.pmod(F.xxhash64("number"), F.greatest(packs, F.lit(1).cast("long")))})
        )
        place = ["dim", "cell", "salt"]
        packed = F.collect_list(F.struct(*names))  # one list, so all columns keep one order
        asked = sent.groupBy(*place, "pack").agg(packed.alias("asked")).select(
            *place, "pack", *[F.col(f"asked.{c}").alias(c) for c in ("number", "own", "label")],
            *[F.flatten(f"asked.{c}").alias(c) for c in ("low", "high", "vec")], F.expr(f"pack div {SLICE_PACKS}").alias("slice"),
        )
        slices = F.greatest(F.ceil(packs / SLICE_PACKS).cast("long"), F.lit(1).cast("long"))
        trees = self.trees.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
        # a tree goes ahead of the packs that meet it, so each task reads it once
        stream = trees.unionByName(asked, allowMissingColumns=True).withColumn("pack", F.coalesce("pack", F.lit(-1).cast("long")))
        stream = stream.repartition(*place, "slice").sortWithinPartitions(*place, "slice", "pack")
        most = self.cells.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, where = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    here = tuple(row[c].as_py() for c in (*place, "slice"))

                    def longs(name):
                        return np.asarray(row[name].values, dtype=np.int64)

                    if row["pack"].as_py() < 0:
                        tree, where = CoverTree(longs("ids"), longs("labels"), longs("vecs").reshape(-1, here[0]), most), here
                        continue
                    if where != here:  # no candidate is there
                        continue
                    limits = (longs(c).reshape(-1, windows) for c in ("low", "high"))
                    asked = Searches(longs("vec").reshape(-1, here[0]), longs("own"), longs("label"), *limits)
                    found = tree.search(asked, k, same)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(longs("number")[found.search]), pa.array(found.window), pa.array(tree.ids[found.row]), pa.array(found.score)],
                        names=["number", "window", "found", "score"],
                    )

        found = stream.mapInArrow(run, "number long, window long, found long, score long")
        rank = F.row_number().over(W.partitionBy("number", "window").orderBy(F.desc("score"), "found"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        return found.join(searches.select("number", *carry), "number")


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector: str = "vec",
    k: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are the ``k`` rows of its label with the highest integer inner products;
    for each, the negatives are the best ``k`` rows of other labels whose score lies between ``low`` and ``high``
    hundredths of the positive's. Ties go to the smaller id, and rows with the anchor's own id are no
    candidates of it. Ids and labels are longs, vectors long arrays; rows with a null among these three or an empty vector take
    no part. Repeated candidate rows count each, repeated anchor rows are answered once; vectors
    of another number of dimensions are never met. Other columns are ignored. Empty tables give an empty result.
    """

    def sound(df: DataFrame) -> DataFrame:
        picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector).alias("vec"))
        return picked.filter("id is not null and label is not null and size(vec) > 0")

    forest = Forest(sound(vectors), k)
    asked = sound(anchors).dropDuplicates(["id", "label", "vec"]).select(
        F.monotonically_increasing_id().alias("number"), F.col("id").alias("own"), "label", "vec",
        F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"),
    )
    asked = land(asked, "anchors")
    positives = forest.best(asked, True, 1, ["own", "label", "vec"])
    # one search an anchor, with a window for each of its positives; an anchor with fewer has windows that nothing fits
    ranked = F.array_sort(F.collect_list(F.struct("rank", "found", "score")))
    gathered = positives.groupBy("number").agg(F.first("own").alias("own"), F.first("label").alias("label"), F.first("vec").alias("vec"), ranked.alias("positives"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("positives", i)["score"])

    def limits(rule: str, none: int) -> Column:
        return F.transform(filled, lambda p: F.coalesce(rounded(rule, p), F.lit(none)))

    def rounded(rule: str, p: Column) -> Column:  # up and down in whole numbers
        if rule == "low":
            return F.call_function("div", p * low + F.pmod(p * -low, F.lit(100)), F.lit(100))
        return F.call_function("div", p * high - F.pmod(p * high, F.lit(100)), F.lit(100))

    asked = land(gathered.withColumns({"low": limits("low", MOST), "high": limits("high", LEAST)}), "windows")
    negatives = forest.best(asked, False, k, ["own", "positives"])
    positive = F.get("positives", F.col("window").cast("int"))
    return negatives.select(
        F.col("own").alias("anchor_id"), positive["found"].alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
