"""N-gram Jaccard join by filtering under several global token orders.

A document's set is its distinct word shingles. Two documents whose Jaccard similarity reaches the
threshold must share a token among the first ``n - ceil(t * n) + 1`` of each, whatever global order
the tokens are sorted by. So a pair is a candidate only if it shares such a prefix token under every
one of several orders, and only candidates are verified:

1. Counts of words and of shingles over all documents go into tables of fixed size, by hash. A
   shingle is at most as frequent as its own counter and as the counters of its words say; the least
   of them gives it a rarity level. Order 1 sorts by level and then by a hash, order 2 by level and
   another hash, order 3 by a third hash alone. Any order is right; these put boilerplate last,
   where it is in no prefix, and what near copies of one text do not share first, where it counts
   against the pair at once.
2. Documents of equal sets become one class. Prefix tokens of the classes under order 1 are grouped
   by token; tokens of a single class are dropped at once.
3. In each token's group all classes are paired with one leader. A pair goes on if, under each of
   the orders, the prefixes share a token and miss few enough of each other's tokens for the
   threshold still to be met. Those left are verified on whole sets, which are made for their
   classes only, and linked classes are put into components.
4. Only pairs of *different* components are still open. For each token that has several, all classes
   outside its largest component are paired with all classes of other components, under length and
   positional bounds, and filtered and verified likewise. Together the two steps find every link
   that could change a component, without forming all pairs of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import chunks, lists, longs, mix
from tidemark.llm.components import components
from tidemark.llm.shared import small_batches, written

# Fixed sizes whatever the input: rarity counters, and bits of the table of candidate classes.
WORD_BITS = 20
SHINGLE_BITS = 21
SLICE = 1 << 12
MEMBER_BITS = 23

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = (np.uint64(0x51ED270B7A2C1F05), np.uint64(0xA24BAED4963EE407), np.uint64(0x8CB92BA72F3D8DD7))
_SET_FIELDS = "n long, sig1 long, sig2 long, prefix array<long>"
_ORDERS = ("first", "second", "third")
_NARROW_FIELDS = "node long, n long, first array<long>, second array<long>, third array<long>"


def _top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = total.reshape(-1, SLICE)
    for at in range(0, len(parts), 64):
        rows = np.arange(at, min(at + 64, len(parts)))
        bounds = np.arange(len(rows) + 1) * SLICE
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(parts[rows].ravel(), pa.int64())
                ),
            ],
            ["slice", "counts"],
        )


def _count(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and shingles by hash, added up over the task, as slices of one table."""
    words = np.zeros(1 << WORD_BITS, np.int64)
    shingles = np.zeros(1 << SHINGLE_BITS, np.int64)
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            h, token, _, _ = _tokens(chunk, width)
            words += np.bincount(_top_bits(h, WORD_BITS), minlength=len(words))
            shingles += np.bincount(_top_bits(token, SHINGLE_BITS), minlength=len(shingles))
    yield from _slices(np.concatenate([words, shingles]))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal slices of a partition; what is held is one table at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        counts = batch.column(1)
        flat = counts.flatten().to_numpy().reshape(-1, SLICE)
        for k, row in zip(batch.column(0).to_pylist(), flat, strict=True):
            held[k] = held[k] + row if k in held else row.copy()
    for k, row in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([row], pa.list_(pa.int64()))], ["slice", "counts"]
        )


def rarity_levels(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """For each counter of words, then of shingles, the bit length of its count, as one byte.

    The tables have 2**WORD_BITS and 2**SHINGLE_BITS counters at any size of input; they order
    tokens and decide nothing.
    """
    fields = "slice int, counts array<long>"
    summed = (
        docs.select(text)
        .mapInArrow(partial(_count, width), fields)
        .repartition("slice")
        .mapInArrow(_add, fields)
        .select("slice", F.transform("counts", lambda n: F.length(F.bin(n)).cast("byte")).alias("level"))
        .toArrow()
    )
    levels = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.uint8)
    for k, level in zip(summed["slice"].to_pylist(), summed["level"], strict=True):
        levels[k * SLICE : (k + 1) * SLICE] = level.values.to_numpy()
    return levels


def _tokens(chunk, width: int):
    """(word hashes, shingle hashes, their words as (first, number), bounds by document)."""
    words = chunk.words()
    h = words.hashes()
    counts = words.counts
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(chunk.docs), per_doc)
    at = words.bounds[doc] + np.arange(bounds[-1]) - bounds[doc]
    length = np.minimum(counts[doc], width)
    token = mix(length.astype(np.uint64))
    for k in range(width):
        here = np.minimum(at + k, max(len(h) - 1, 0))
        token = np.where(k < length, mix(token * _STEP + h[here]), token)
    return h, token, (at, length), bounds


def _shingles(chunk, width: int, levels: np.ndarray):
    """(tokens, levels, bounds): shingle hashes of each document, repeats still in."""
    h, token, (at, length), bounds = _tokens(chunk, width)
    low = levels[(1 << WORD_BITS) + _top_bits(token, SHINGLE_BITS)]
    level = levels[_top_bits(h, WORD_BITS)]
    for k in range(width):
        here = np.minimum(at + k, max(len(h) - 1, 0))
        low = np.where(k < length, np.minimum(low, level[here]), low)
    return token, low, bounds


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ordered(token: np.ndarray, level: np.ndarray | None, salt: np.uint64, size: int) -> np.ndarray:
    """The first ``size`` order keys under one global order, ascending. A key stands for its token:
    equal tokens have equal keys, and keys that agree by chance only let a pair go on."""
    key = mix(token ^ salt) >> np.uint64(6)
    if level is not None:
        key |= np.minimum(level, 31).astype(np.uint64) << np.uint64(58)
    if size < len(key):
        key = key[np.argpartition(key, size - 1)[:size]]
    return np.sort(key)


def _distinct(token: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, first = np.unique(token, return_index=True)
    return found, level[first]


def _prefixes(levels, width, percent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            token, low, bounds = _shingles(chunk, width, levels.value)
            n = np.zeros(chunk.docs, np.int64)
            sigs = np.zeros((2, chunk.docs), np.uint64)
            prefixes = []
            for d in range(chunk.docs):
                own, own_level = _distinct(
                    token[bounds[d] : bounds[d + 1]], low[bounds[d] : bounds[d + 1]]
                )
                n[d] = len(own)
                if len(own):
                    sigs[0, d] = mix(own * _STEP).sum(dtype=np.uint64)
                    sigs[1, d] = mix(own ^ _SALTS[2]).sum(dtype=np.uint64)
                    size = _prefix_size(len(own), percent)
                    prefixes.append(_ordered(own, own_level, _SALTS[0], size))
                else:
                    prefixes.append(own)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            ids = batch.column("doc_id").slice(chunk.first, chunk.docs)
            yield pa.RecordBatch.from_arrays(
                [ids, longs(n), longs(sigs[0]), longs(sigs[1]), lists(np.concatenate(prefixes), ends)],
                ["doc_id", "n", "sig1", "sig2", "prefix"],
            )


def _member(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


def _narrow_sets(
    levels, members, width, percent, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Prefixes under all orders, of documents in the member table."""
    for ids, chunk in _kept(members, batches):
        token, low, bounds = _shingles(chunk, width, levels.value)
        orders = ([], [], [])
        sizes = np.zeros(chunk.docs, np.int64)
        for d in range(chunk.docs):
            own, level = _distinct(token[bounds[d] : bounds[d + 1]], low[bounds[d] : bounds[d + 1]])
            sizes[d] = len(own)
            size = _prefix_size(len(own), percent) if len(own) else 0
            for found, by, salt in zip(orders, (level, level, None), _SALTS, strict=True):
                found.append(_ordered(own, by, salt, size) if size else own)
        yield pa.RecordBatch.from_arrays(
            [ids, longs(sizes), *[_list_of(found) for found in orders]], ["node", "n", *_ORDERS]
        )


def _whole_sets(
    levels, members, width, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Whole sets of documents in the member table."""
    for ids, chunk in _kept(members, batches):
        token, _, bounds = _shingles(chunk, width, levels.value)
        found = [np.unique(token[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([ids, _list_of(found)], ["node", "tokens"])


def _list_of(parts: list[np.ndarray]) -> pa.Array:
    return lists(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def _kept(members, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        at = _member(batch.column("doc_id").to_numpy())
        keep = (members.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        kept = batch.filter(pa.array(keep.astype(bool)))
        for chunk in chunks(kept.column("text")):
            yield kept.column("doc_id").slice(chunk.first, chunk.docs), chunk


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of nodes in the member table, by byte; at most one row per byte and task."""
    table = np.zeros(1 << MEMBER_BITS, bool)
    for batch in batches:
        table[_member(batch.column(0).to_numpy())] = True
    packed = np.packbits(table, bitorder="little")
    used = np.flatnonzero(packed)
    for at in range(0, len(used), 50_000):
        part = used[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(packed[part].astype(np.int64))], ["byte", "bits"]
        )


def _member_table(nodes: DataFrame) -> np.ndarray:
    """One bit per node by hash, in a table of 2**MEMBER_BITS bits at any size of input.

    It spares the texts of documents without candidates a second look; nodes that only look like
    members cost time and change nothing.
    """
    found = (
        nodes.mapInArrow(_members, "byte long, bits long")
        .groupBy("byte")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros((1 << MEMBER_BITS) // 8, np.uint8)
    table[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return table


def _side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
    return sets.select(
        F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns]
    )


def _filtered(pairs: DataFrame, narrow: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can still reach the threshold under every one of the orders.

    A token of a's prefix that does not lie beyond b's prefix is in b only if it is in b's prefix.
    So the ones that are not there are missing from b, and bound the overlap.
    """
    joined = pairs.join(_side(narrow, "a", "n", *_ORDERS), "a").join(
        _side(narrow, "b", "n", *_ORDERS), "b"
    )

    def missing(own: str, other: str) -> Column:
        last = F.element_at(other, -1)
        reach = F.size(F.filter(own, lambda key: key <= last))
        return reach - F.size(F.array_intersect(own, other))

    passes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    needed = percent * (F.col("a_n") + F.col("b_n"))
    for order in _ORDERS:
        a, b = f"a_{order}", f"b_{order}"
        overlap = F.least(F.col("a_n") - missing(a, b), F.col("b_n") - missing(b, a))
        passes &= F.arrays_overlap(a, b) & ((100 + percent) * overlap >= needed)
    return joined.where(passes).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""
    union = F.size("a_tokens") + F.size("b_tokens") - F.col("shared")
    return (
        pairs.join(_side(sets, "a", "tokens"), "a")
        .join(_side(sets, "b", "tokens"), "b")
        .withColumn("shared", F.size(F.array_intersect("a_tokens", "b_tokens")))
        .where(100 * F.col("shared") >= percent * union)
        .select("a", "b")
    )


def _open_pairs(postings: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs within a token's group that are in different components and within the bounds."""
    placed = written(
        postings.join(comps, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("token", "leader", "node", "n", "pos", "component")
    )
    sizes = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        sizes.groupBy("token")
        .agg(F.max_by("component", "size").alias("largest"), F.count(F.lit(1)).alias("parts"))
        .where(F.col("parts") > 1)
        .select("token", "largest")
    )
    held = placed.join(mixed, "token")
    # What a token's leader has in common with the rest of the group has been tested already.
    led = held.where(F.col("node") != F.col("leader"))
    few = led.where(F.col("component") != F.col("largest")).select(
        "token", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "component")]
    )
    many = led.select(
        "token", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos", "component")]
    )
    # The first shared token in the order leaves at most this many for the overlap.
    overlap = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    needed = percent * (F.col("x_n") + F.col("y_n"))
    bounds = (
        (F.col("x_component") != F.col("y_component"))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & ((100 + percent) * overlap >= needed)
    )
    return (
        few.join(many, (few["token"] == many["token"]) & bounds)
        .select(
            F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")
        )
        .distinct()
    )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are what is left between ASCII white space after lowering A-Z; the set is the distinct
    ``width``-word shingles, or the whole sequence where there are fewer words. Documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest id reachable.

    Null or empty text: no shingles, own component. Null id: counted, linked with nothing, null
    component. Rows that repeat an id are one node of the link graph and come out once each. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(rarity_levels(source, "text", width))
    sets = written(
        source.mapInArrow(
            partial(_prefixes, levels, width, percent), f"doc_id long, {_SET_FIELDS}"
        )
    )
    key = ["n", "sig1", "sig2"]
    classes = written(
        sets.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("node"), F.any_value("prefix").alias("prefix"))
    )
    tokens = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    common = (
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("classes"), F.min("node").alias("leader"))
        .where(F.col("classes") > 1)
        .select("token", "leader")
    )
    postings = written(tokens.join(common, "token"))
    known = source.where(F.col("doc_id").isNotNull())

    def of_members(nodes: DataFrame, make, *options) -> DataFrame:
        members = spark.sparkContext.broadcast(_member_table(nodes.select("node")))
        fields = _NARROW_FIELDS if make is _narrow_sets else "node long, tokens array<long>"
        return written(
            known.mapInArrow(partial(make, levels, members, width, *options), fields)
        )

    narrow = of_members(postings, _narrow_sets, percent)

    def linked(pairs: DataFrame) -> DataFrame:
        left = written(_filtered(pairs, narrow, percent))
        nodes = left.select(F.col("a").alias("node")).unionByName(
            left.select(F.col("b").alias("node"))
        )
        return written(_verified(left, of_members(nodes, _whole_sets), percent))

    tested = written(
        postings.where(F.col("leader") != F.col("node"))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = linked(tested)
    comps = components(links, "a", "b")
    late = linked(_open_pairs(postings, comps, percent).join(tested, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        comps = components(links.unionByName(late), "a", "b")
    joined = classes.select(*key, "node").join(comps, "node", "left")
    placed = joined.select(*key, F.coalesce("component", "node").alias("component"))
    return (
        sets.select("doc_id", *key)
        .join(placed, key, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
                "component_id"
            ),
        )
    )
