"""Token counts from flat token files that hold nothing but token ids.

A token file is a run of 16-bit ids in which an end-of-document id follows every document; there is
no index. It is read in blocks of bytes that are cut without regard to documents. In each block all
ends are found by one vectorised comparison; what lies between two of them is counted at once. A
document that reaches over blocks is put together by a prefix scan over the blocks of its file: the
number of ends before a block numbers its documents, and the tokens since the last end are carried
in. Ids are 0 to 65535, in the byte order of little-endian machines.

``token_files`` makes such files from documents, as rows of a table: one per block, with the file's
number and the block's place in it. Any store that Spark writes can hold them. ``read_files`` gives
the same rows for files that lie in a folder as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, written

BLOCK_BYTES = 1 << 19
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
# Fixed value: how this vocabulary's texts are split before its merges.
_SPAN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCKS = "file long, block long, data binary, docs array<struct<row:long,doc_id:long>>"


def encoder(ranks: str, pattern: str = _SPAN):
    """The byte-pair encoding of a file of ranks, without special tokens."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def _write_blocks(
    ranks: str, end: int, block_bytes: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """One file per task: tokens in blocks of exactly ``block_bytes``, the last one shorter. The ids
    of the documents that begin since the last block travel beside it, in order."""
    encoding = encoder(ranks)
    file = TaskContext.get().partitionId()
    held, ids, block = bytearray(), [], 0

    def row(data: bytes):
        kind = pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file], pa.int64()),
                pa.array([block], pa.int64()),
                pa.array([data], pa.binary()),
                pa.array([ids], kind),
            ],
            ["file", "block", "data", "docs"],
        )

    for batch in batches:
        keys = batch.column("key").to_pylist()
        for key, text in zip(keys, batch.column("text").to_pylist(), strict=True):
            tokens = encoding.encode_ordinary(text) if text else []
            ids.append(key)
            held += np.array([*tokens, end], "<u2").tobytes()
            while len(held) >= block_bytes:
                yield row(bytes(held[:block_bytes]))
                del held[:block_bytes]
                ids = []
                block += 1
    if held or ids:
        yield row(bytes(held))


def token_files(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = RANKS,
    end: int = END,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(file, block, data, docs): the documents as flat token files, written in the shared folder.

    ``docs`` is a list of names beside the file, in the order of its documents, not an index: it says
    nothing about where they are.
    """
    small_batches(docs.sparkSession)
    source = docs.select(
        F.struct(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id")
        ).alias("key"),
        F.col(text_col).alias("text"),
    )
    return written(source.mapInArrow(partial(_write_blocks, ranks, end, block_bytes), _BLOCKS))


def read_files(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) for flat files in a folder; ``file`` is the path. A file is read by one
    task, so files should be written in parts of some hundred megabytes."""
    content = spark.read.format("binaryFile").load(folder).where("length > 0")
    parts = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes).cast("int"))
    data = F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes))
    return content.select(F.col("path").alias("file"), "content", F.explode(parts).alias("block")).select(
        "file", F.col("block").cast("long").alias("block"), data.alias("data")
    )


def _ends(end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: its tokens, and the tokens of each document that ends in it, as far as they are
    within the block."""
    for batch in batches:
        sizes, found = [], []
        for data in batch.column("data"):
            tokens = np.frombuffer(data.as_buffer(), "<u2")
            at = np.flatnonzero(tokens == end)
            sizes.append(len(tokens))
            found.append(np.diff(at, prepend=-1) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("block"),
                pa.array(sizes, pa.int64()),
                pa.array(found, pa.list_(pa.int64())),
            ],
            ["file", "block", "size", "lengths"],
        )


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, nth, n_tokens) per document of each file, in order, its end not counted.

    Tokens after a file's last end are a document without one and counted too. A block must have a
    whole number of ids. Empty blocks change nothing, an empty table gives no rows.
    """
    small_batches(blocks.sparkSession)
    kind = blocks.schema["file"].dataType.simpleString()
    found = written(
        blocks.select("file", "block", "data").mapInArrow(
            partial(_ends, end), f"file {kind}, block long, size long, lengths array<long>"
        )
    )
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("lengths").cast("long")
    # Tokens that follow the block's last end; the whole block, if there is none.
    inside = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n + 1)
    placed = found.withColumns({"ends": ends, "rest": F.col("size") - inside}).withColumns(
        {
            "nth": F.coalesce(F.sum("ends").over(before), F.lit(0)),
            # A block that has an end begins a stretch of blocks that carry into one another.
            "stretch": F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)),
        }
    )
    # The rest of the block that ended the stretch before, and the whole blocks since.
    since = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = placed.withColumn("whole", F.coalesce(F.sum("size").over(since), F.lit(0))).withColumn(
        "left",
        F.coalesce(
            F.last(F.when(F.col("ends") > 0, F.col("rest")), ignorenulls=True).over(before), F.lit(0)
        ),
    )
    carry = F.col("whole") + F.col("left")
    closed = carried.where("ends > 0").select(
        "file",
        "nth",
        carry.alias("carry"),
        F.posexplode("lengths").alias("place", "length"),
    )
    documents = closed.select(
        "file",
        (F.col("nth") + F.col("place")).alias("nth"),
        (F.col("length") + F.when(F.col("place") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
    )
    tails = (
        carried.withColumn("is_last", F.lead("block").over(in_file).isNull())
        .where("is_last")
        .select(
            "file",
            (F.col("nth") + F.col("ends")).alias("nth"),
            F.when(F.col("ends") > 0, F.col("rest")).otherwise(carry + F.col("size")).alias("n_tokens"),
        )
        .where("n_tokens > 0")
    )
    return documents.unionByName(tails)


def document_tokens(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, file, nth.

    The documents are written as token files, the files are scanned, and counts and names are put
    together by file and order. Null and empty texts have no tokens. Null ids and repeated rows are
    counted like any other, an empty table gives no rows. ``options`` go to ``token_files``.
    """
    files = token_files(docs, **options)
    counts = scan(files, options.get("end", END))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = (
        files.select("file", "block", "docs")
        .withColumn("before", F.coalesce(F.sum(F.size("docs")).over(in_file), F.lit(0)))
        .select("file", "before", F.posexplode("docs").alias("place", "key"))
        .select("file", (F.col("before") + F.col("place")).alias("nth"), "key.doc_id")
    )
    return names.join(counts, ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth")
