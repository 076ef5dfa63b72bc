"""Hard negatives: per anchor and positive, the best rows of other labels within a window of scores.

Scores are inner products of whole-number vectors. Every row is indexed in cover trees of bounded
size, kept as a table with a row per tree:

* by cell, the rows nearest to one of at most ``max_cells`` centres. The centres come from a bounded
  sample; the cells' radii are measured over all rows;
* by label, and by label and cell where a label has more rows than a tree.

An anchor is searched in two steps, for positives among the trees of its label and for negatives
among the trees of all cells. It first visits the cell it lies in, which gives a score that the
results must reach, and then only the cells that can hold better ones, by their radius. Visits and
trees meet by key: they are sorted so that a tree is read ahead of its visitors, and a task holds one
tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.cover_tree import LONGEST, Tree, augmented, each, farthest_first, ranges
from tidemark.llm.shared import small_batches, written

#: Queries bounded together, and visitors of one tree in one group.
QUERY_ROWS = 256
GROUP_VISITS = 16384


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components rounded down to whole numbers, and each vector's squared norm."""
    for batch in batches:
        column = batch.column("v")
        values = np.floor(column.flatten().to_numpy(zero_copy_only=False))
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        sums = np.concatenate([[0.0], np.cumsum(values * values)])
        # Whole squares add up exactly, so differences of running sums do too.
        exact = sums[-1] < 2.0**52
        squares = (
            sums[bounds[1:]] - sums[bounds[:-1]]
            if exact
            else [float((v * v).sum()) for v in np.split(values, bounds[1:-1])]
        )
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
        own = batch.drop_columns(["v"])
        yield pa.RecordBatch.from_arrays(
            [*own.columns, lists, pa.array(np.asarray(squares, np.float64))],
            [*own.schema.names, "v", "square"],
        )


@dataclass
class Cells:
    """Centres by vector length, and each cell's radius and number of rows."""

    norm: float
    centres: dict[int, np.ndarray]
    radii: dict[str, float]

    def of(self, size: int) -> np.ndarray:
        """Augmented centres of vectors of a length; one at zero if the sample had none of it."""
        return self.centres.get(size, np.concatenate([np.zeros(size), [self.norm]])[None])


def _grouped(lengths: np.ndarray):
    for size in np.unique(lengths):
        yield int(size), np.flatnonzero(lengths == size)


def _placed(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's nearest centre and its distance from it."""
    cells: Cells = shared.value
    for batch in batches:
        for size, own in _grouped(batch.column("v").value_lengths().to_numpy()):
            part = batch.take(pa.array(own))
            centres = cells.of(size)
            points = augmented(_matrix(part.column("v")), cells.norm)
            squares = (points * points).sum(1)[:, None] - 2 * points @ centres.T
            near = (squares + (centres * centres).sum(1)).argmin(1)
            apart = np.sqrt(((points - centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([f"{size}:{k}" for k in near]), pa.array(apart)],
                [*part.schema.names, "cell", "apart"],
            )


_VISIT = "row long, label string, v array<double>, windows array<struct<least: long, most: long>>"


def _visited(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells other than its own that can hold a score within a window of the query."""
    cells: Cells = shared.value
    for batch in batches:
        for size, own in _grouped(batch.column("v").value_lengths().to_numpy()):
            part = batch.take(pa.array(own))
            centres = cells.of(size)
            names = [f"{size}:{k}" for k in range(len(centres))]
            radii = np.array([cells.radii.get(n, -1.0) for n in names])
            low, high = ranges(centres[:, :-1], radii, _matrix(part.column("v")), cells.norm)
            windows = part.column("windows").to_pylist()
            least = np.array([min(w["least"] for w in ws) for ws in windows], np.float64)
            most = np.array([max(w["most"] for w in ws) for ws in windows], np.float64)
            open_ = (high >= least[:, None]) & (low <= most[:, None]) & (radii >= 0)
            at = part.column("cell").to_pylist()
            reached = [
                [n for n, o in zip(names, row, strict=True) if o and n != mine]
                for row, mine in zip(open_, at, strict=True)
            ]
            kept = part.drop_columns(["cell"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(reached, pa.list_(pa.string()))],
                [*kept.schema.names, "cells"],
            )


def _built(norm: float, key: tuple, table: pa.Table) -> pa.Table:
    """One tree over the rows of a key."""
    ids = table.column("id")
    tree = Tree.of(
        _matrix(table.column("v")),
        table.column("row").to_numpy(),
        ids.fill_null(0).to_numpy(),
        ids.is_null().to_numpy(),
        np.array(table.column("label").to_pylist(), str),
        norm,
    )
    named = {"key": [key[0]], "part": [key[1]], "tree": [pa.scalar(tree.dumps(), pa.binary())]}
    return pa.table({n: pa.array([v.as_py()], v.type) for n, (v,) in named.items()})


def _searched(same: bool, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of a tree for each visit; trees arrive ahead of their visits."""
    tree = None
    for batch in batches:
        trees = batch.column("tree")
        starts = np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], starts, [batch.num_rows]])).astype(int)
        for first, last in zip(cuts, cuts[1:], strict=False):
            if trees[first].is_valid:
                tree, first = Tree.loads(trees[first].as_py()), first + 1
            for part in each(np.arange(first, last), QUERY_ROWS):
                visits = batch.slice(first + part.start, min(part.stop, last - first) - part.start)
                yield _results(tree, visits, same, k)


def _results(tree: Tree, visits: pa.RecordBatch, same: bool, k: int) -> pa.RecordBatch:
    queries = _matrix(visits.column("v"))
    windows = [
        np.array([(w["least"], w["most"]) for w in ws], np.int64)
        for ws in visits.column("windows").to_pylist()
    ]
    least = np.array([w[:, 0].min() for w in windows], np.float64)
    most = np.array([w[:, 1].max() for w in windows], np.float64)
    low, high = tree.bounds(queries, least, most)
    rows = visits.column("row").to_numpy()
    labels = visits.column("label").to_pylist()
    out: list[tuple] = []
    for n, q in enumerate(queries):
        best = tree.best(q, int(rows[n]), labels[n], same, k, windows[n], low[n], high[n])
        for w, (places, scores) in enumerate(best):
            out += [(rows[n], w, p, s) for p, s in zip(places, scores, strict=True)]
    row, window, place, score = np.array(out, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row),
            pa.array(window.astype(np.int32)),
            pa.array(score),
            pa.array(tree.ids[place], mask=tree.unknown[place]),
        ],
        ["row", "window", "score", "id"],
    )


_FOUND = "row long, window int, score long, id long"


def _indexed(rows: DataFrame, keys: DataFrame, norm: float) -> DataFrame:
    """Trees over ``rows`` (key, row, id, label, v), in as many parts as ``keys`` (key, parts) says."""
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    dealt = rows.join(keys, "key").select("key", part.alias("part"), "row", "id", "label", "v")
    return written(
        dealt.groupBy("key", "part").applyInArrow(
            lambda key, table: _built(norm, key, table), "key string, part int, tree binary"
        )
    )


def _search(trees: DataFrame, keys: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of every visited tree for each window of each visit (key and _VISIT)."""
    groups = 1 + visits.count() // GROUP_VISITS
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    fields = [f.split(" ", 1) for f in _VISIT.split(", ", 3)]
    one_each = visits.join(keys, "key").select(
        "key",
        F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"),
        group.alias("group"),
        F.lit(None).cast("binary").alias("tree"),
        *[name for name, _ in fields],
    )
    copies = trees.select(
        "key",
        "part",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "tree",
        *[F.lit(None).cast(kind).alias(name) for name, kind in fields],
    )
    both = copies.unionByName(one_each).repartition("key", "part", "group")
    return both.sortWithinPartitions(
        "key", "part", "group", F.col("tree").isNull()
    ).mapInArrow(partial(_searched, same, k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, ranked."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _raised(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Queries whose windows begin at the last of ``k`` results found so far."""
    reached = (
        first.where(F.col("rank") == k)
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    )
    windows = F.transform(
        "windows",
        lambda w, n: F.struct(
            F.greatest(w["least"], F.try_element_at("reached", n)).alias("least"),
            w["most"].alias("most"),
        ),
    )
    return queries.join(reached, "row", "left").withColumn("windows", windows).drop("reached")


def _window(percents: tuple[int, int]) -> Column:
    """Least and greatest whole number within ``percents`` of a score, without leaving a long."""
    hundreds, rest = F.expr("(score - pmod(score, 100)) div 100"), F.pmod("score", F.lit(100))
    low, high = (F.lit(p) for p in percents)
    least = low * hundreds + F.ceil(low * rest / 100)
    most = high * hundreds + F.floor(high * rest / 100)
    empty = least > most
    return F.struct(
        F.when(empty, F.lit(LONGEST)).otherwise(least).alias("least"),
        F.when(empty, F.lit(-LONGEST)).otherwise(most).alias("most"),
    )


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 3,
    percents: tuple[int, int] = (50, 95),
    tree_rows: int = 2048,
    max_cells: int = 256,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    ``anchors`` tells which rows are anchors (null counts as not). A component ``x`` counts as the
    whole number below ``scale * x``, and a score is an inner product of these. An anchor's
    positives are the ``positives`` best other rows of its label (``label``, by default the column),
    and a positive's negatives the ``negatives`` best rows of other labels whose scores are within
    ``percents`` of the positive's. Higher scores come first, then smaller ids, null ids last.

    Rows with a null label or vector, or with a component that is null, not finite, or not finite
    once scaled, take no part. Vectors of different lengths have no score and never meet; an empty
    vector scores 0 with other empty ones. Repeated rows count each; an anchor's own copy is an
    other row. Scores beyond a long stay at its ends. A positive without a negative has no row, and
    an empty table gives none. Other columns are ignored, whatever their names.

    ``max_cells`` and the sample of 16 rows a cell that centres are taken from shape the index and
    decide nothing: every row is indexed and the search is exact. The driver holds the centres, and
    a radius a cell and vector length.
    """
    spark = small_batches(rows.sparkSession)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    named = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        (F.col(label_col) if label is None else label).cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        v.alias("v"),
    ).where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    base = "row long, id long, label string, anchor boolean, v array<double>"
    floored = written(named.mapInArrow(_floored, f"{base}, square double"))
    total = floored.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    norm = float(np.sqrt(total["square"] or 0.0)) * (1 + 1e-12)

    count = max(1, min(max_cells, -(-total["n"] // tree_rows)))
    sample = floored.orderBy(F.xxhash64("row"), "row").limit(16 * count).select("v").toArrow()
    centres = {}
    for size, own in _grouped(np.array([len(x) for x in sample["v"]], np.int64)):
        points = augmented(_matrix(sample["v"].take(pa.array(own))), norm)
        centres[size] = points[farthest_first(points, count)[0]]
    cells = Cells(norm, centres, {})
    sent = spark.sparkContext.broadcast(cells)
    placed = written(
        floored.drop("square").mapInArrow(
            partial(_placed, sent), f"{base}, cell string, apart double"
        )
    )
    measured = placed.groupBy("cell").agg(
        F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")
    )
    measured = written(measured)
    cells.radii = {r["cell"]: r["radius"] for r in measured.collect()}
    sent = spark.sparkContext.broadcast(cells)

    parts = F.ceil(F.col("n") / F.lit(tree_rows)).alias("parts")
    by_cell = measured.select(F.col("cell").alias("key"), parts)
    sizes = placed.groupBy("label").agg((F.count(F.lit(1)) > tree_rows).alias("split"))
    # Lengths are part of a cell's name; labels that are not split still keep lengths apart.
    within = F.when(F.col("split"), F.col("cell")).otherwise(F.substring_index("cell", ":", 1))
    keyed = written(
        placed.join(sizes, "label").withColumn("key", F.concat(within, F.lit("/"), F.col("label")))
    )
    by_label = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", parts))
    label_trees = _indexed(keyed, by_label, norm)
    cell_trees = _indexed(placed.withColumn("key", F.col("cell")), by_cell, norm)

    visit = [f.split(" ", 1)[0] for f in _VISIT.split(", ", 3)]
    visited_fields = f"{_VISIT}, split boolean, cells array<string>"

    def searched(queries, trees, keys, same, k, home_key, far_key):
        """Results of ``queries`` (_VISIT, cell, split) at home and then in other cells."""
        home = written(
            _first(_search(trees, keys, queries.select(home_key.alias("key"), *visit), same, k), k)
        )
        raised = _raised(queries, home, k).select(*visit, "split", "cell")
        others = written(raised.mapInArrow(partial(_visited, sent), visited_fields))
        away = others.withColumn("cell", F.explode("cells")).where(far_key.isNotNull())
        found = _search(trees, keys, away.select(far_key.alias("key"), *visit), same, k)
        return written(_first(home.drop("rank").unionByName(found), k))

    anchored = keyed.where("anchor")
    whole = F.array(
        F.struct(F.lit(-LONGEST - 1).alias("least"), F.lit(LONGEST).alias("most"))
    )
    queries = written(anchored.withColumn("windows", whole).select(*visit, "split", "cell", "key"))
    far = F.when(F.col("split"), F.concat("cell", F.lit("/"), "label"))
    best = searched(queries, label_trees, by_label, True, positives, F.col("key"), far)

    ranked = F.sort_array(F.collect_list(F.struct("rank", _window(percents).alias("w"))))
    windows = best.groupBy("row").agg(F.transform(ranked, lambda r: r["w"]).alias("windows"))
    asked = written(
        queries.drop("windows")
        .join(windows.where(F.exists("windows", lambda w: w["least"] <= w["most"])), "row")
        .select(*visit, "split", "cell")
    )
    worst = searched(asked, cell_trees, by_cell, False, negatives, F.col("cell"), F.col("cell"))
    ids = anchored.select("row", F.col("id").alias("anchor_id"))
    pairs = best.select(
        "row",
        (F.col("rank") - 1).alias("window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    ).join(ids, "row")
    return pairs.join(worst, ["row", "window"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
