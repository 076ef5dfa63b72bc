"""Language-model scores of whole documents: exact unigram counts and a recurrent model.

Three passes over the texts:

1. Words are counted over all training documents, combined in each task before the shuffle.
2. The recurrent model is fitted in rounds. In each round every task trains, from the same weights,
   on its share of that round's training documents, and the weights are averaged by the number of
   tokens behind them. What is read and shuffled follows the size of the corpus.
3. Every document is scored whole. The most frequent words, a table of fixed size, are looked up in
   the task. Occurrences of all other words are joined with the exact counts by their hash; no word
   among them is frequent enough to make a hot key.

The recurrent model has a small vocabulary. A word outside it has the probability of the class of
outside words in its context, times its smoothed share of the training words outside.
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

from tidemark.llm import gru
from tidemark.llm.bytescan import chunks, lists, longs, mix
from tidemark.llm.shared import small_batches, written

TABLE_WORDS = 1 << 16
SLOT_BITS = 21
END = mix(np.array([0x454E44], np.uint64))[0]
#: Tokens handled together in a task: enough to fill the lanes, and a bound on a worker's memory.
GROUP_TOKENS = 3_000_000
MERGE_WORDS = 1_000_000
#: Weights sent together when tasks' weights are averaged.
SLICE_WEIGHTS = 1 << 14


@dataclass
class Model:
    """Corpus figures, the table of frequent words, and the recurrent model's weights.

    ``words`` and ``counts`` are ordered by count; the model's vocabulary is a prefix of them.
    """

    tokens: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    vocabulary: int
    weights: gru.Weights | None = None

    @property
    def outside(self) -> int:
        """The model's id of words it does not know."""
        return self.vocabulary - 1

    @property
    def known(self) -> int:
        return min(self.vocabulary - 1, len(self.words))

    @property
    def end(self) -> int:
        """The model's id of the end of a document."""
        found = np.flatnonzero(self.words[: self.known] == END)
        return int(found[0]) if len(found) else self.outside

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def log_outside(self) -> float:
        rest = self.tokens - int(self.counts[: self.known].sum())
        return float(np.log10(rest + 0.5 * (self.distinct - self.known + 1)))


class Lookup:
    """Ranks of frequent words by hash: two tables of slots, the most frequent word in each."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(1, np.uint64)])
        self.slots = [np.full(1 << SLOT_BITS, len(words), np.int32) for _ in range(2)]
        rank = np.arange(len(words), dtype=np.int32)[::-1]
        for table, at in zip(self.slots, self._at(words), strict=True):
            table[at[::-1]] = rank

    @staticmethod
    def _at(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << SLOT_BITS) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word; -1 where it is not in the table. Of the few words that find both of
        their slots taken none is in the table, and they are treated like any rare word."""
        first, second = self._at(h)
        a = self.slots[0][first]
        missed = np.flatnonzero(self.words[a] != h)
        b = self.slots[1][second[missed]]
        a[missed] = np.where(self.words[b] == h[missed], b, -1)
        return a


def _unique_sums(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.diff(words, prepend=words[:1] ^ np.uint64(1)) != 0)
    return words[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (word, end) per task; merged whenever many have gathered."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = docs = 0

    def merged():
        words = np.concatenate([w for w, _ in held])
        return _unique_sums(words, np.concatenate([c for _, c in held]))

    def rows(words, counts):
        for at in range(0, len(words), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([longs(words[part]), longs(counts[part])], ["word", "n"])

    for batch in batches:
        docs += batch.num_rows
        for chunk in chunks(batch.column(0)):
            held.append(np.unique(chunk.words().hashes(), return_counts=True))
            size += len(held[-1][0])
            if size > MERGE_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > MERGE_WORDS // 2:
                    yield from rows(*held[0])
                    held, size = [], 0
    if docs:
        held.append((np.array([END], np.uint64), np.array([docs], np.int64)))
        yield from rows(*merged())


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of each word's hash, ends of documents included."""
    return (
        docs.select(text)
        .mapInArrow(_count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _encode(chunk, lookup: Lookup, model: Model):
    """Model ids of a chunk's documents with their ends, bounds, and the ranks behind them."""
    words = chunk.words()
    h = words.hashes()
    ranks = lookup.ranks(h)
    ids = np.where((ranks >= 0) & (ranks < model.known), ranks, model.outside)
    bounds = words.bounds + np.arange(chunk.docs + 1)
    out = np.empty(len(ids) + chunk.docs, np.int16)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = model.end
    out[~last] = ids
    return out, bounds, h, ranks, words


def _groups(batches: Iterator[pa.RecordBatch], lookup: Lookup, model: Model):
    """Encoded chunks until they hold GROUP_TOKENS tokens, with the rows they come from."""
    held, size = [], 0
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            held.append((batch, chunk, *_encode(chunk, lookup, model)))
            size += len(held[-1][2])
            if size >= GROUP_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _flat(group) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.cumsum([0] + [len(x[2]) for x in group])
    bounds = np.concatenate([[0]] + [x[3][1:] + at for x, at in zip(group, sizes, strict=False)])
    return np.concatenate([x[2] for x in group]), bounds


def _fit(
    shared: Broadcast, lanes: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Weights after training on the task's documents, each times the tokens behind it."""
    model = shared.value
    lookup, weights, seen = Lookup(model.words), model.weights, 0
    for group in _groups(batches, lookup, model):
        tokens, bounds = _flat(group)
        placed = gru.Lanes.of(tokens, bounds, lanes)
        weights = gru.train(weights, placed, model.end)
        seen += len(tokens)
    if seen:
        flat = weights.flat()
        for k, at in enumerate(range(0, len(flat), SLICE_WEIGHTS)):
            values = flat[at : at + SLICE_WEIGHTS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k], pa.int32()),
                    pa.array([values], pa.list_(pa.float32())),
                    pa.array([float(seen)]),
                ],
                ["slice", "values", "weight"],
            )


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of equal slices; what is held is one set of weights at most."""
    sums: dict[int, tuple[np.ndarray, float]] = {}
    for batch in batches:
        for k, values, weight in zip(*(c for c in batch.columns), strict=True):
            own, weight = values.values.to_numpy().astype(np.float64), weight.as_py()
            held, so_far = sums.get(k.as_py(), (0.0, 0.0))
            sums[k.as_py()] = (held + own * weight, so_far + weight)
    for k, (values, weight) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([values / weight], pa.list_(pa.float64()))],
            ["slice", "values"],
        )


def _scores(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    lookup = Lookup(model.words)
    logs = np.log10(np.concatenate([model.counts, [0]]) + 0.5)  # -1: nothing of a rare word
    logs[-1] = 0.0
    ends = int(model.counts[np.flatnonzero(model.words == END)].sum())
    end_log = float(np.log10(ends + 0.5))
    for group in _groups(batches, lookup, model):
        tokens, bounds = _flat(group)
        found = gru.score(model.weights, gru.Lanes.of(tokens, bounds, 256), model.end)
        at = 0
        for batch, chunk, _, _, h, ranks, words in group:
            docs = chunk.docs

            def summed(values, words=words, docs=docs):
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[words.bounds[1:]] - sums[words.bounds[:-1]]

            rare = ranks < 0
            log = logs[ranks]
            beyond = ranks >= model.known
            rows = batch.slice(chunk.first, docs)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("row"),
                    longs(words.counts + 1),
                    longs(summed(~rare) + int(ends > 0)),
                    pa.array(summed(log) + end_log),
                    longs(summed(beyond | rare)),
                    pa.array(summed(np.where(beyond, log, 0.0))),
                    pa.array(found[at : at + docs] / np.log(10)),
                    lists(h[rare], np.concatenate([[0], np.cumsum(summed(rare))])),
                ],
                ["row", "n_tokens", "seen", "log_seen", "outside", "log_beyond", "model", "rare"],
            )
            at += docs


_SCORE_FIELDS = (
    "row long, n_tokens long, seen long, log_seen double, outside long, log_beyond double, "
    "model double, rare array<long>"
)


def _corpus_model(counted: DataFrame, vocabulary: int, hidden: int) -> Model:
    totals = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counted.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).toArrow()
    words = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    counts = top.column("n").to_numpy().astype(np.int64)
    model = Model(int(totals["n"] or 0), int(totals["v"]), words, counts, vocabulary)
    shares = np.zeros(vocabulary)
    shares[: model.known] = counts[: model.known]
    shares[model.outside] = model.tokens - counts[: model.known].sum()
    model.weights = gru.initial(vocabulary, hidden, shares)
    return model


def fit(
    training: DataFrame,
    counted: DataFrame,
    vocabulary: int = 4096,
    hidden: int = 16,
    rounds: int = 4,
    share: float = 1.0,
    lanes: int = 512,
) -> Model:
    """Corpus figures and a recurrent model from ``training`` (row, text) and its word counts.

    The training rows are cut into ``rounds`` disjoint parts, seen one after the other. ``share``
    below one leaves rows out of the fit, at every size alike; counts and totals are always over all
    of them.
    """
    spark = training.sparkSession
    model = _corpus_model(counted, vocabulary, hidden)
    if not model.tokens:
        return model
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 20))
    width = share * (1 << 20) / rounds
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        mine = training.where((part >= int(k * width)) & (part < int((k + 1) * width)))
        got = (
            mine.select("text")
            .mapInArrow(partial(_fit, sent, lanes), "slice int, values array<float>, weight double")
            .repartition("slice")
            .mapInArrow(_averaged, "slice int, values array<double>")
            .toArrow()
            .sort_by("slice")
        )
        if got.num_rows:
            flat = got.column("values").combine_chunks().flatten().to_numpy()
            model.weights = model.weights.like(flat)
    return model


def lm_scores(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.

    ``training`` tells which rows are learned from (null counts as not); the others are held out.
    Tokens are the words between ASCII white space after lowering A-Z, then one end. ``base_score``
    sums ``log10((c + 0.5) / (N + 0.5 * (V + 1)))`` over them, ``score`` is the recurrent model's
    log10 probability of the whole text, end included. ``options`` go to ``fit``.

    Null text is an empty text. Null ids and repeated rows are scored like any other. With nothing
    to learn from every word is unknown, and the model is the untrained one. Other columns are
    ignored. An empty table gives no rows. Weights are averaged over tasks, so ``score`` depends on
    how the input is cut; all other columns do not.
    """
    spark = small_batches(docs.sparkSession)
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(training, F.lit(False)).alias("learn"),
    )
    learned = source.where("learn").select(F.col("doc_id").alias("row"), "text")
    counted = written(count_words(learned, "text"))
    model = fit(learned, counted, **options)
    sent = spark.sparkContext.broadcast(model)
    packed = source.select(
        F.struct(F.monotonically_increasing_id().alias("row"), "doc_id", "learn").alias("row"),
        "text",
    )
    row_type = packed.schema["row"].dataType.simpleString()
    scored = written(
        packed.mapInArrow(
            partial(_scores, sent), _SCORE_FIELDS.replace("row long", f"row {row_type}")
        ).select("row.*", *[f.split()[0] for f in _SCORE_FIELDS.split(", ")[1:]])
    )
    rare = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(counted, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("log_rare"),
            F.count("n").alias("known_rare"),
        )
    )
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return (
        scored.drop("rare")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            (~F.col("learn")).alias("held_out"),
            "n_tokens",
            (F.col("seen") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("log_seen") + log_rare - F.col("n_tokens") * model.log_total).alias(
                "base_score"
            ),
            (
                F.col("model") + F.col("log_beyond") + log_rare - F.col("outside") * model.log_outside
            ).alias("score"),
        )
    )
