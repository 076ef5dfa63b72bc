"""A Merkle manifest of a table by time-forward processing: digests go up, then proofs come down.

Rows are leaves. Each partition of the tree (``lang``) is a tree of its own over its rows in order
of id, and the trees' roots, in order of name, are the leaves of one more. Every eight neighbours
become one node, until one is left.

A node's label is the last leaf below it and its level, so labels put children before parents. A
sweep in that order reads the leaves and hands every digest on through a priority queue: a node
takes what has been sent to its label, hashes it, and sends the result to its parent's label. The
queue is external at two scales. A task sweeps whole blocks of ``8 ** LEVELS`` leaves, which Spark's
sort delivers in order; within it the queue holds eight digests a level at most. The tops of blocks
are sent on through the shuffle to the blocks above, so no task and no driver holds a tree. The way
down is the same sweep in reverse: a node takes the proof sent to its label and sends each child its
siblings' digests with that proof behind them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import small_batches, written

FANOUT = 8
LEVELS = 4
BLOCK = FANOUT**LEVELS

_ABOVE = "array<struct<left: string, right: string>>"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above ``n`` leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def leaf_digest(*values: Column) -> Column:
    """Hash of a row: each value as its byte count, a colon and its text; a hyphen for null."""
    coded = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in (value.cast("string") for value in values)
    ]
    return F.sha2(F.concat(*coded), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``index``, their place in their ``tree`` by ``order``, and ``n``, its size.

    Rows are sorted into ranges, numbered in each range, and shifted by the sizes of earlier ranges
    of the same tree: a table of a row per range and tree. Ties beyond ``order`` are spread.
    """
    keys = ["tree", *order]
    # Rows alike in everything may end up in any order, and must not end up in one range.
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())
    placed = written(
        spread.repartitionByRange(*keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
    )
    tree = Window.partitionBy("tree")
    ranges = (
        placed.groupBy("tree", "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(
            "tree",
            "_range",
            (F.sum("_n").over(tree.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_by"),
            F.sum("_n").over(tree).alias("n"),
        )
    )
    return (
        placed.join(ranges, ["tree", "_range"])
        .withColumn("index", F.col("_at") + F.col("_by"))
        .drop("_at", "_range", "_by")
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("index") / F.lit(BLOCK)).cast("long"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield _table(held, schema)
            held = []
    if held:
        yield _table(held, schema)


def _swept(block: Iterator[dict], top: int) -> str:
    """The digest of a block's node at level ``top``, sweeping its leaves in order of label."""
    queue: list[tuple[int, int, int, str]] = []  # last leaf, level, child, digest

    def send(child: int, level: int, digest: str) -> None:
        parent = child // FANOUT
        last = (parent + 1) * FANOUT ** (level + 1) - 1
        heapq.heappush(queue, (last, level + 1, child, digest))

    def process() -> str:
        last, level, child, digest = heapq.heappop(queue)
        parts = [digest]
        while queue and queue[0][:2] == (last, level):
            parts.append(heapq.heappop(queue)[3])
        made = _hash("".join(parts))
        if level < top:
            send(child // FANOUT, level, made)
        return made

    made = ""
    for leaf in block:
        while queue and queue[0][0] < leaf["index"]:
            made = process()
        made = leaf["digest"]
        if top:
            send(leaf["index"], 0, made)
    while queue:
        made = process()
    return made


_NODE = pa.schema(
    [("tree", pa.string()), ("index", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]
)


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top of every block; blocks arrive one after the other, their leaves in order."""

    def tops():
        for (tree, block, n), leaves in groupby(
            _rows(batches), lambda r: (r["tree"], r["block"], r["n"])
        ):
            digest = _swept(leaves, min(LEVELS, _height(n)))
            yield {"tree": tree, "index": block, "n": -(-n // BLOCK), "digest": digest}

    yield from _in_batches(tops(), _NODE)


def risen(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` (tree, index, n, digest), the tops of their blocks, the tops of blocks of these,
    and so on; the last table has one row a tree. How many there are follows from the largest n."""
    tables = [leaves]
    largest = leaves.agg(F.max("n").alias("n")).first()["n"] or 1
    while largest > 1:
        below = _blocks(tables[-1].select("tree", "index", "n", "digest"))
        sorted_in = below.repartition("tree", "block").sortWithinPartitions("tree", "index")
        tables.append(
            written(sorted_in.mapInArrow(_rise, "tree string, index long, n long, digest string"))
        )
        largest = -(-largest // BLOCK)
    return tables


def _fallen(top: dict, leaves: list[dict]) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Each leaf of a block with its siblings on every level up to the root, the nearest first."""
    levels = [[leaf["digest"] for leaf in leaves]]
    while len(levels) <= min(LEVELS, _height(leaves[0]["n"])):
        below = levels[-1]
        levels.append(
            [_hash("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)]
        )
    # Labels within the block, negated: parents come before their children, later ones first.
    above = [(s["left"], s["right"]) for s in top["above"]]
    queue = [(-len(leaves), -(len(levels) - 1), 0, above)]
    while queue:
        _, level, k, proof = heapq.heappop(queue)
        if not level:
            yield leaves[k], proof
            continue
        below = levels[-level - 1]
        first = k * FANOUT
        run = below[first : first + FANOUT]
        for at in range(len(run)):
            siblings = ("".join(run[:at]), "".join(run[at + 1 :]))
            last = (first + at + 1) * FANOUT ** (-level - 1) - 1
            heapq.heappush(queue, (-last, level + 1, first + at, [siblings, *proof]))


def _delivered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, list]]:
    """(top, leaf, siblings) of every leaf; a block's top arrives ahead of its leaves."""
    for _, rows in groupby(_rows(batches), lambda r: (r["tree"], r["block"])):
        top, *leaves = rows
        for leaf, proof in _fallen(top, leaves):
            yield top, leaf, proof


_TOP = f"tree string, index long, above {_ABOVE}, subroot string, root string"
_SIBLINGS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_TOP_ARROW = pa.schema(
    [
        ("tree", pa.string()),
        ("index", pa.int64()),
        ("above", _SIBLINGS),
        ("subroot", pa.string()),
        ("root", pa.string()),
    ]
)


def _fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs for the nodes of a level, which are the tops of blocks one level further down. A node
    with an ``item`` is a whole tree's root, and goes on as the top of that tree."""

    def rows():
        for top, leaf, proof in _delivered(batches):
            inner = leaf["item"] is not None
            yield {
                "tree": leaf["item"] if inner else leaf["tree"],
                "index": 0 if inner else leaf["index"],
                "above": [{"left": a, "right": b} for a, b in proof],
                "subroot": leaf["digest"] if inner else top["subroot"],
                "root": top["root"],
            }

    yield from _in_batches(rows(), _TOP_ARROW)


_PROOF = (
    "item string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)
_PROOF_ARROW = pa.schema(
    [(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.string()) for f in _PROOF.split(", ")]
)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold each row's leaf, as found now, with the siblings of the manifest up to the root."""

    def rows():
        for top, leaf, proof in _delivered(batches):
            folded = leaf["found"]
            for left, right in proof:
                folded = _hash(f"{left}{folded}{right}")
            yield {
                "item": leaf["item"],
                "leaf": leaf["digest"],
                "subroot": top["subroot"],
                "root": top["root"],
                "proof_sha256": _hash("".join([a + b for a, b in proof])),
                "folded_root": folded,
                "verified": folded == top["root"],
            }

    yield from _in_batches(rows(), _PROOF_ARROW)


def _below(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tops and the leaves of their blocks side by side, each top ahead of its leaves."""
    fields = {
        "index": "long",
        "n": "long",
        "digest": "string",
        "item": "string",
        "found": "string",
        "above": _ABOVE,
        "subroot": "string",
        "root": "string",
    }

    def whole(df: DataFrame, block: Column) -> DataFrame:
        known = set(df.columns)
        columns = [
            (F.col(c) if c in known else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()
        ]
        return df.select("tree", block.alias("block"), *columns)

    both = whole(tops.withColumn("block", F.col("index")).drop("index"), F.col("block")).unionByName(
        whole(_blocks(nodes), F.col("block"))
    )
    order = F.col("index").asc_nulls_first()
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", order)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    tree_col: str = "lang",
    found: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf is the hash of its ``fields``. ``found`` is the leaf digest that is checked against
    the manifest, by default the same; ``folded_root`` is what it and the proof's siblings lead to,
    and ``verified`` whether that is the root. ``proof_sha256`` is the hash of all siblings from the
    leaf's run up to the root's.

    Rows lie in ``tree_col``'s trees (null first, then by bytes) by id, nulls first; rows with the
    same id lie in order of leaf, then of ``found``. The texts stay where they are read: only
    digests are shuffled. Null and empty texts differ. Any text length will do, as hashing is
    Spark's own. Other columns are ignored, whatever their names. An empty table gives no rows, and
    a single row is its own root.
    """
    small_batches(docs.sparkSession)
    named = F.col(tree_col).cast("string")
    leaf = leaf_digest(*[F.col(f) for f in fields])
    # Written first, since a range partitioning evaluates its input twice.
    hashed = written(
        docs.select(
            F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("tree"),
            F.col(id_col).alias("id"),
            leaf.alias("digest"),
            (leaf if found is None else found).alias("found"),
        )
    )
    leaves = written(numbered(hashed, ["id", "digest", "found"]))
    trees = risen(leaves)
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("item"), "digest")
    upper = risen(written(numbered(roots, ["item"])))
    tops = upper[-1].select(
        "tree",
        F.lit(0).cast("long").alias("index"),
        F.array().cast(_ABOVE).alias("above"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"),
    )
    # The last table of each sweep is the tops themselves, so the way down starts one below.
    way = [*reversed(upper[:-1] or upper), *reversed(trees[1:-1])]
    tops = reduce(lambda above, nodes: written(_below(above, nodes).mapInArrow(_fall, _TOP)), way, tops)
    kind = leaves.schema["id"].dataType
    proofs = _below(tops, leaves.withColumn("item", F.col("id").cast("string")))
    return proofs.mapInArrow(_prove, _PROOF).select(
        F.col("item").cast(kind).alias(id_col), *[f.split()[0] for f in _PROOF.split(", ")[1:]]
    )

