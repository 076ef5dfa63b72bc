"""Benchmark decontamination by a prefix-filtered join of shingles.

An item is a set of windows of ``window`` consecutive words (the whole item, if it is shorter). A
window occurs in a document only if each of its shingles does, so it is enough to look for one of
them, and the rarest makes the shortest join:

1. Every document becomes words once. Positions whose shingle may be one of the benchmark's, by a
   bitmap of fixed size, are kept with the words around them; nothing else of a text goes further.
2. Kept positions are joined with the benchmark's shingles, which gives each shingle's number of
   occurrences over all documents, the order of rarity.
3. Each window's rarest shingle, its prefix, is joined with the positions. The shingle's place in
   the window gives the one place where the window can begin; places before the text's first word
   or too close to its last are out of bounds, and the words there are compared with the window's.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import let, lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap, at any size of the benchmark. A full bitmap would only let more positions on
#: to the join.
BITMAP_BITS = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + F.lit(k)) for k in range(width)])


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words) per distinct window of an item."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    return (
        benchmark.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
        .where(n > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start") + 1, window).alias("words"))
        .distinct()
    )


def _shingles_of(windows: DataFrame, width: int) -> DataFrame:
    """(window, words, width, offset, shingle): all shingles of each distinct window."""
    size = F.least(F.size("words"), F.lit(width))
    found = windows.withColumn("width", size).withColumn(
        "offset", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width")))
    )
    text = F.concat_ws(" ", F.slice("words", F.col("offset") + 1, F.col("width")))
    return found.withColumn("shingle", text)


def _slot(shingle: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(shingle), 64 - BITMAP_BITS)


def _bitmap(shingles: DataFrame) -> list[int]:
    """One bit per shingle by hash, as a fixed number of longs."""
    slot = _slot(F.col("shingle"))
    rows = (
        shingles.select(F.shiftright(slot, 6).alias("at"), (slot % 64).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()
    )
    table = [0] * (1 << (BITMAP_BITS - 6))
    for r in rows:
        table[r["at"]] = r["bits"]
    return table


def _positions(docs: DataFrame, bitmaps: dict[int, list[int]], window: int) -> DataFrame:
    """Per document: its words' number, and positions that may matter with the words around."""

    def marked(words: Column, width: int, table: Column) -> Column:
        def known(i: Column) -> Column:
            slot = _slot(_shingle(words, i, width))
            bits = F.get(table, F.shiftright(slot, 6).cast("int"))
            return F.getbit(bits, (slot % 64).cast("int")) == 1

        last = F.size(words) - width
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        reach = window - width

        def around(i: Column) -> Column:
            first = F.greatest(i - reach, F.lit(0))
            return F.struct(
                i.alias("pos"),
                F.lit(width).alias("width"),
                _shingle(words, i, width).alias("shingle"),
                first.alias("first"),
                F.slice(words, first + 1, F.lit(window + reach)).alias("around"),
            )

        return F.transform(F.filter(at, known), around)

    def found(words: Column) -> Column:
        parts = [
            let(
                F.array(*[F.lit(v) for v in table]).cast("array<long>"),
                partial(marked, words, width),
            )
            for width, table in bitmaps.items()
        ]
        empty = F.array().cast(
            "array<struct<pos:int,width:int,shingle:string,first:int,around:array<string>>>"
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.concat(*parts) if parts else empty).alias("found"),
        )

    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            let(words_of(F.col("text")), found).alias("scan"),
        ).select("*", "scan.n_words", "scan.found").drop("scan")
    )


def occurrences(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, width: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(scan, hits) from docs (doc_id, text) and benchmark (item_id, text).

    ``scan`` has a row per document with ``row``, ``doc_id`` and ``n_words``; ``hits`` a row
    (row, start, size, window) per occurrence of a window, and ``window`` is its words as text.
    """
    distinct = written(
        windows_of(benchmark, "item_id", "text", window)
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("window", F.concat_ws(" ", "words"))
    )
    shingles = written(_shingles_of(distinct.select("window", "words"), width))
    widths = [r[0] for r in shingles.select("width").distinct().collect()]  # 1 .. width
    bitmaps = {w: _bitmap(shingles.where(F.col("width") == w)) for w in sorted(widths)}
    scan = _positions(docs, bitmaps, window)
    spots = scan.select("row", "n_words", F.inline("found"))
    known = shingles.select("width", "shingle").distinct()
    counts = (
        spots.groupBy("width", "shingle")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(known, ["width", "shingle"])
    )
    # A window all of whose shingles have been seen has its rarest as prefix; a window with a
    # shingle that occurs nowhere occurs nowhere itself.
    prefixes = (
        shingles.join(counts, ["width", "shingle"], "left")
        .groupBy("window")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "width", "shingle")).alias(
                "rarest"
            ),
            F.any_value("words").alias("words"),
        )
        .where("rarest.n > 0")
        .select("window", "words", "rarest.offset", "rarest.width", "rarest.shingle")
    )
    start = F.col("pos") - F.col("offset")
    size = F.size("words")
    bounds = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice("around", start - F.col("first") + 1, size) == F.col("words")
    hits = (
        spots.join(prefixes, ["width", "shingle"])
        .where(bounds)
        .where(same)
        .select("row", start.alias("start"), size.alias("size"), "window")
    )
    return scan, hits.join(distinct.select("window", "items"), "window")


def _hit_words(hits: DataFrame) -> DataFrame:
    """(row, n_hit): words inside any occurrence, counted once each."""
    in_order = Window.partitionBy("row").orderBy("start")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    return (
        hits.groupBy("row", "start")
        .agg(F.max("size").alias("size"))
        .withColumn("fresh", F.greatest(end - F.greatest("start", reached), F.lit(0)))
        .groupBy("row")
        .agg(F.sum("fresh").alias("n_hit"))
    )


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    width: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. Items are told apart
    by id; rows that repeat an item add nothing, and items without an id or without a word are left
    out. Null text has no words. Null ids and repeated rows of ``docs`` come out as they are. Other
    columns are ignored. Without items every document is clean; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scan, hits = occurrences(source, benchmark.select("item_id", "text"), window, width)
    found = written(hits)
    items = (
        found.select("row", F.explode("items").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("names"),
        )
    )
    counted = _hit_words(found.select("row", "start", "size")).join(items, "row")
    n_hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return (
        scan.drop("found")
        .join(counted, "row", "left")
        .withColumns(
            {
                "n_hit": n_hit.cast("long"),
                "n_items": F.coalesce("n_items", F.lit(0)).cast("long"),
                "items_sha256": F.sha2(F.concat_ws(",", names), 256),
                "contaminated": n_hit > 0,
            }
        )
        .drop("row", "names")
    )
