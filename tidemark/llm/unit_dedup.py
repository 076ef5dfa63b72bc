"""Substring dedup by hashing lines, paragraphs, or passages that the words themselves mark.

Texts are cut into units; each is normalised and becomes a 128-bit digest with its offsets. Digests
are grouped over all documents, the earliest ranked occurrence of each stays, and all others are
removed. Only digests and offsets are shuffled, never text. A unit that very many documents share is
met by partial aggregates, and by a join whose large side can be split.

A passage that another text breaks into other lines, or that is part of a longer line, has no line or
paragraph in common with its copies. ``repeated_passages`` hashes units that depend on words alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, written

_BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[^\\S\n]*(?:\n[^\\S\n]*)+")}


def units(text: str, by: str) -> list[tuple[int, int]]:
    """Start and end of each unit in code points, without the breaks between them."""
    found, at = [], 0
    for m in _BREAKS[by].finditer(text):
        found.append((at, m.start()))
        at = m.end()
    found.append((at, len(text)))
    return found


def normalised(unit: str) -> str:
    """Compatibility forms unified, case folded, white space as single blanks, none at the ends."""
    return " ".join(unicodedata.normalize("NFKC", unit).casefold().split())


def _digests(by: str, min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, low, high, spans = [], [], [], []
        for row, text in zip(
            batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            if not text:
                continue
            for start, end in units(text, by):
                plain = normalised(text[start:end])
                if plain.count(" ") + 1 < min_words or not plain:
                    continue
                digest = hashlib.blake2b(plain.encode(), digest_size=16).digest()
                rows.append(row)
                low.append(int.from_bytes(digest[:8], "little", signed=True))
                high.append(int.from_bytes(digest[8:], "little", signed=True))
                spans.append((start, end))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, batch.schema.field("row").type),
                pa.array(low, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array([s for s, _ in spans], pa.int64()),
                pa.array([e for _, e in spans], pa.int64()),
            ],
            ["row", "low", "high", "start", "end"],
        )


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    by: str = "line",
    min_words: int = 10,
) -> DataFrame:
    """One row per unit to remove: doc_id, start, end, digest, first_doc_id, first_start, copies.

    ``start`` and ``end`` are offsets in the original text, in code points, end exclusive. The
    earliest occurrence by id and then by offset stays, null ids come last; ``first_doc_id`` and
    ``first_start`` say where it is, and ``copies`` how many occurrences there are. Units of fewer
    than ``min_words`` words are left alone, so short lines that agree by chance are. ``by`` is
    ``line`` or ``paragraph``.

    Null and empty texts have no units. Repeated rows are copies of each other, the first of them in
    a fixed but arbitrary order. Other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    source = docs.select(
        F.struct(
            F.monotonically_increasing_id().alias("nth"), F.col(id_col).cast("long").alias("doc_id")
        ).alias("row"),
        F.col(text_col).alias("text"),
    )
    found = written(
        source.mapInArrow(
            partial(_digests, by, min_words),
            "row struct<nth:long,doc_id:long>, low long, high long, start long, end long",
        ).select("row.*", "low", "high", "start", "end")
    )
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    place = F.struct(last.alias("order"), "nth", "start")
    key = ["low", "high"]
    # Digests that occur once need no first place; the cheap count sorts them out.
    shared = (
        found.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )
    candidates = written(found.join(shared, key))
    firsts = candidates.groupBy(*key).agg(
        F.min(F.struct(place.alias("place"), "doc_id")).alias("first")
    )
    return (
        candidates.join(firsts, key)
        .where(place != F.col("first.place"))
        .select(
            "doc_id",
            "start",
            "end",
            F.concat(F.hex("low"), F.hex("high")).alias("digest"),
            F.col("first.doc_id").alias("first_doc_id"),
            F.col("first.place.start").alias("first_start"),
            "copies",
        )
    )


#: Words in a passage, and in the unit that marks it: of any ``PASSAGE`` words in a row, the unit with
#: the least digest, the last of equal ones, is marked. Equal passages mark equal units.
PASSAGE = 50
_UNIT = 26
_ROOM = PASSAGE - _UNIT

_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 28


def _word_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word, compatibility forms unified and case folded; never 0."""
    found = []
    for word in _WORD.findall(text):
        value = known.get(word)
        if value is None:
            if len(known) > 500_000:
                known.clear()
            plain = unicodedata.normalize("NFKC", word).casefold().encode("utf-8", "replace")
            digest = hashlib.blake2b(plain, digest_size=8).digest()
            value = known[word] = int.from_bytes(digest, "little") | 1
        found.append(value)
    return np.array(found, np.uint64)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` words in a row."""
    places = np.full(len(hashes) + 1, _BASE, np.uint64)
    places[0] = 1
    powers = np.multiply.accumulate(places)
    back = np.full(len(hashes) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])])
    mixed = (sums[size:] - sums[:-size]) * np.multiply.accumulate(back)[: len(hashes) - size + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def _marks(digests: np.ndarray) -> np.ndarray:
    """Places of the units that are the least of ``_ROOM + 1`` in a row."""
    bits = np.uint64(_PLACE_BITS)
    last_first = np.arange(len(digests), 0, -1).astype(np.uint64)
    least, width = (digests >> bits << bits) | last_first, 1
    while width < _ROOM + 1:
        step = min(width, _ROOM + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    kept = np.unique(least) & np.uint64((1 << _PLACE_BITS) - 1)
    return len(digests) - kept.astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marked units of each text, with the digest of all passages they may stand for."""
    known: dict[str, int] = {}
    for batch in batches:
        docs, ids, ats, ends, units_, arounds = [], [], [], [], [], []
        for doc, tid, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "text")), strict=True):
            hashes = _word_hashes(text or "", known)
            if len(hashes) < PASSAGE:
                continue
            digests = _runs(hashes, _UNIT)
            at = _marks(digests)
            around = _runs(np.pad(hashes, _ROOM), _UNIT + 2 * _ROOM)
            docs.append(np.full(len(at), doc))
            ids.append(np.full(len(at), tid))
            ats.append(at)
            ends.append(np.minimum(at + PASSAGE, len(hashes)))
            units_.append(digests[at].view(np.int64))
            arounds.append(around[at].view(np.int64))
        columns = [
            np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)
            for c in (docs, ids, ats, ends, units_, arounds)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["doc", "tid", "at", "end", "unit", "around"]
        )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the passages round the given marks of each text."""
    known: dict[str, int] = {}
    for batch in batches:
        docs, ids, ats, found = [], [], [], []
        for doc, tid, text, marks in zip(
            *(batch.column(c).to_pylist() for c in ("doc", "tid", "text", "marks")), strict=True
        ):
            digests = _runs(_word_hashes(text, known), PASSAGE)
            near = np.unique(np.add.outer(np.array(marks, np.int64), np.arange(-_ROOM, 1)))
            at = near[(near >= 0) & (near < len(digests))]
            docs.append(np.full(len(at), doc))
            ids.append(np.full(len(at), tid))
            ats.append(at)
            found.append(digests[at].view(np.int64))
        columns = [
            np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)
            for c in (docs, ids, ats, found)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["doc", "tid", "at", "passage"]
        )


def _merged(lists: pa.ListArray) -> pa.ListArray:
    """Each row's spans in order, those that meet or overlap as one."""
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    starts, ends = (flat.field(k).to_numpy() for k in ("start", "end"))
    firsts, lasts, sizes = [], [], [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            order = np.argsort(starts[a:b], kind="stable")
            start, end = starts[a:b][order], np.maximum.accumulate(ends[a:b][order])
            cut = np.flatnonzero(start[1:] > end[:-1])
            firsts.append(start[np.append(0, cut + 1)])
            lasts.append(end[np.append(cut, len(end) - 1)])
        sizes.append(len(firsts[-1]) if a < b else 0)
    values = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (firsts, lasts)]
    spans = pa.StructArray.from_arrays([pa.array(v) for v in values], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans)


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "tid", "words", "later", "shared"]
    for batch in batches:
        columns = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(
            [*columns[:3], *(_merged(c) for c in columns[3:])],
            ["doc", "tid", "words", "removed", "shared"],
        )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, removed, shared, arrays of struct(start, end).

    A passage is ``PASSAGE`` words in a row, whatever the breaks between them. ``removed`` spans the
    passages that occur earlier, by id and then by place, in this or another document; one that
    overlaps its own first occurrence is no repetition. ``shared`` spans those that another document
    has too, so the first ones are among them. Spans count words, from 0, end exclusive, and do not
    meet; words are parted by white space, compatibility forms are unified and case is folded.

    Units of 26 words are marked so that every passage holds one and equal passages the same. Only
    units that occur twice go on. Where all 24 words on either side agree too, all passages round a
    unit are repeated at once; only round units with differing neighbours are passages hashed one by
    one, once for each kind of neighbours. So every repeated passage is found. Digests have 64 bits.

    Rows equal in id and text are copies, all but one of them removed as a whole if they hold a
    passage. Null ids come last; texts of fewer words than a passage have no spans.
    """
    small_batches(docs.sparkSession)
    last = (1 << 63) - 1
    doc, tid = F.coalesce(F.col(id_col).cast("long"), F.lit(last)), F.xxhash64(text_col)
    source = docs.select(doc.alias("doc"), tid.alias("tid"), F.col(text_col).alias("text"))
    identity = ["doc", "tid"]
    marked = written(
        source.mapInArrow(
            _marked, "doc long, tid long, at long, end long, unit long, around long"
        )
    )
    # Units that occur once are no part of a repetition; the cheap count sorts them out. What is met
    # is written first: Spark splits a hot key only where both sides of a join come from a shuffle.
    twice = written(
        marked.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
    )
    held = written(marked.join(twice, "unit"))
    place = F.struct(*identity, "at")
    kinds = written(
        held.groupBy("unit", "around").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    )
    differing = written(
        kinds.groupBy("unit").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    )

    def same_text(one: str, other: str) -> Column:
        return (F.col(f"{one}doc") == F.col(f"{other}doc")) & (
            F.col(f"{one}tid") == F.col(f"{other}tid")
        )

    apart = ~same_text("first.", "") | (F.col("at") >= F.col("first.at") + PASSAGE)
    known = written(kinds.join(differing, "unit", "left"))
    placed = written(
        held.join(known, ["unit", "around"])
        .select(
            *identity,
            "at",
            F.greatest(F.col("at") - _ROOM, F.lit(0).cast("long")).alias("start"),
            "end",
            apart.alias("later"),
            (~same_text("first.", "last.")).alias("shared"),
            F.col("kinds").isNotNull().alias("differs"),
        )
    )
    open_marks = (
        placed.where("differs AND NOT (later AND shared)")
        .groupBy(*identity)
        .agg(F.collect_list("at").alias("marks"))
    )
    single = written(
        source.where(F.col("text").isNotNull())
        .join(open_marks, identity)
        .mapInArrow(_passages, "doc long, tid long, at long, passage long")
    )
    met = written(
        single.groupBy("passage")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
    )
    matched = single.join(met, "passage").select(
        *identity,
        F.col("at").alias("start"),
        (F.col("at") + PASSAGE).alias("end"),
        apart.alias("later"),
        (~same_text("first.", "last.")).alias("shared"),
    )
    span = F.struct("start", "end")
    spans = (
        placed.drop("at", "differs")
        .unionByName(matched)
        .groupBy(*identity)
        .agg(
            F.max("end").alias("words"),
            F.collect_list(F.when(F.col("later"), span)).alias("later"),
            F.collect_list(F.when(F.col("shared"), span)).alias("shared"),
        )
        .mapInArrow(
            _joined_spans,
            "doc long, tid long, words long, removed array<struct<start:long,end:long>>, "
            "shared array<struct<start:long,end:long>>",
        )
    )
    copy = F.row_number().over(Window.partitionBy(*identity).orderBy(F.lit(1)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), doc.alias("doc"), tid.alias("tid")
    ).withColumn("copy", copy)
    # All units of rows that repeat are held, so the last of them ends where the text does.
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("words").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return rows.join(spans, identity, "left").select(
        "doc_id",
        F.when((F.col("copy") > 1) & F.col("words").isNotNull(), whole)
        .otherwise(F.coalesce("removed", none))
        .alias("removed"),
        F.coalesce("shared", none).alias("shared"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the spans, an array of struct(start, end) in order that do not overlap."""
    edges = F.concat(
        F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    )
    pairs = F.sequence(F.lit(0), F.size(edges) - 1, F.lit(2))

    def between(i: Column) -> Column:
        start = F.get(edges, i)
        end = F.coalesce(F.get(edges, i + 1), F.length(text).cast("long"))
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    return F.array_join(F.transform(pairs, between), "")


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    by: str = "line",
    min_words: int = 10,
) -> DataFrame:
    """``docs`` with the repeated units cut out of the text, and ``removed``, their offsets in the
    original text. Ids must be unique and not null; the breaks around a removed unit stay."""
    cuts = (
        repeated_units(docs, id_col, text_col, by, min_words)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    )
    joined = docs.join(cuts, F.col(id_col) == F.col("_id"), "left").drop("_id")
    cut = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(
        without_spans(F.col(text_col), F.col("removed"))
    )
    return joined.withColumn(text_col, cut)
