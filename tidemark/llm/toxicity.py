"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word is read as its own vector, if the training sample has it often enough, beside the mean of the
vectors of its letter trigrams. Texts are cut into overlapping windows of words. In each window one
recurrence runs forwards and one backwards, attention weighs their states, and the weighted mean
gives the window's log-odds. A text scores as its highest window, so training lets each text learn
from the window that scores highest at the time.

The network is fitted in numpy on a bounded sample of the labelled rows; all texts are then scored
whole in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.bytescan import Chunk, chunks
from tidemark.llm.shared import small_batches

WINDOW = 32
STRIDE = 16
#: Longer texts are read in pieces; windows are the same as of the whole.
PIECE_BYTES = 1 << 21
LANES = 4096

TRIGRAM_BITS = 12
WORD_SIZE, LETTER_SIZE, HIDDEN, ATTENTION = 16, 8, 8, 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Read:
    """Words of a chunk: for each token its place among the distinct words, the distinct words'
    hashes and trigrams, and the windows as first token and length, in order of document."""

    tokens: np.ndarray
    hashes: np.ndarray
    trigrams: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    length: np.ndarray
    windows: np.ndarray

    @staticmethod
    def of(chunk: Chunk, whole: bool = True) -> Read:
        """``whole`` is false where the text goes on: windows it could add to are left out."""
        words = chunk.tokens(_LETTER[chunk.data])
        hashes, at, tokens = np.unique(words.hashes(), return_index=True, return_inverse=True)
        starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
        ends = np.cumsum(sizes)
        place = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        padded = np.concatenate([[0x20], chunk.data, [0x20]]).astype(np.uint32)
        before, own, after = padded[place], padded[place + 1], padded[place + 2]
        before[ends - sizes] = 0x20
        after[ends - 1] = 0x20
        mixed = (before | own << 8 | after << 16) * np.uint32(0x9E3779B1)
        trigrams = (mixed >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int32)
        counts = words.counts
        if not whole:
            counts = counts - 1  # the last word may be cut
        windows = np.where(counts > 0, 1 + np.maximum(counts - WINDOW + STRIDE - 1, 0) // STRIDE, 0)
        if not whole:
            windows = np.maximum((counts - WINDOW) // STRIDE + 1, 0)
        n = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        skipped = STRIDE * n
        return Read(
            tokens.astype(np.int32),
            hashes,
            trigrams,
            ends,
            np.repeat(words.bounds[:-1], windows) + skipped,
            np.minimum(np.repeat(counts, windows) - skipped, WINDOW),
            windows,
        )


@dataclass
class Network:
    """Weights by name, hashes of the words with a vector of their own (row 0 is for all others),
    and the line that turns the sample's log-odds into those of all labelled rows."""

    words: np.ndarray
    base: float
    shift: float = 0.0
    scale: float = 1.0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(words: np.ndarray, base: float, shift: float, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape, scale=None):
            return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

        size = WORD_SIZE + LETTER_SIZE
        weights = {
            "word": draw(len(words) + 1, WORD_SIZE, scale=0.1),
            "letters": draw(1 << TRIGRAM_BITS, LETTER_SIZE, scale=0.1),
            "look": draw(2 * HIDDEN, ATTENTION),
            "weigh": draw(ATTENTION),
            "out": draw(2 * HIDDEN),
            "bias": np.zeros(1, np.float32),
        }
        for way in ("on", "back"):
            weights[f"{way}_in"] = draw(size, 3 * HIDDEN)
            weights[f"{way}_bias"] = np.zeros(3 * HIDDEN, np.float32)
            weights[f"{way}_state"] = draw(HIDDEN, 3 * HIDDEN)
        return Network(words, base, shift, weights=weights)

    def rows(self, read: Read) -> np.ndarray:
        """The word vector that each distinct word has."""
        at = np.searchsorted(self.words, read.hashes)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == read.hashes[known]
        return np.where(known, at + 1, 0)

    def inputs(self, read: Read, rows: np.ndarray) -> np.ndarray:
        """Word vectors and mean trigram vectors of all distinct words."""
        sizes = np.diff(read.ends, prepend=0)[:, None]
        letters = np.add.reduceat(self.weights["letters"][read.trigrams], read.ends - sizes[:, 0])
        return np.concatenate([self.weights["word"][rows], letters / sizes], 1).astype(np.float32)

    def run(self, inputs: np.ndarray, ids: np.ndarray, length: np.ndarray, keep: dict | None = None):
        """Log-odds of windows: a column of ``ids`` is a window, read up to its length."""
        w, steps = self.weights, len(ids)
        real = np.arange(steps)[:, None] < length
        start = np.zeros((ids.shape[1], HIDDEN), np.float32)
        both, blank = [], np.zeros((0, 0), np.float32)
        for way in ("on", "back"):
            turned = slice(None, None, -1 if way == "back" else 1)
            given = ids[turned]
            fresh = np.zeros(ids.shape, bool)
            if way == "back":
                # The way back begins at a window's last word.
                fresh[steps - length, np.arange(len(length))] = length < steps
            own = gru.Weights(inputs @ w[f"{way}_in"] + w[f"{way}_bias"], w[f"{way}_state"], blank, blank)
            steps_kept = None if keep is None else []
            states, _ = gru.advance(own, given, fresh, start, steps_kept)
            both.append(states[turned])
            if keep is not None:
                keep[way] = (own, given, fresh, steps_kept)
        states = np.concatenate(both, 2)
        looked = np.tanh(states @ w["look"])
        pull = np.where(real, looked @ w["weigh"], -np.inf)
        share = np.exp(pull - pull.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        if keep is not None:
            keep |= {"states": states, "looked": looked, "share": share, "pooled": pooled}
        return pooled @ w["out"] + w["bias"][0]

    def gradients(self, read: Read, rows, inputs, ids, length, target, weight) -> tuple[dict, float]:
        """Ascent direction of the weighted log-likelihood of ``target``, and that likelihood."""
        w, keep = self.weights, {}
        odds = self.run(inputs, ids, length, keep)
        chance = 1 / (1 + np.exp(-odds))
        d = ((target - chance) * weight).astype(np.float32)
        states, looked, share = keep["states"], keep["looked"], keep["share"]
        grads = {"bias": d.sum(keepdims=True), "out": keep["pooled"].T @ d}
        at_pooled = d[:, None] * w["out"]
        at_share = np.einsum("tbh,bh->tb", states, at_pooled)
        at_states = share[:, :, None] * at_pooled
        at_pull = share * (at_share - (share * at_share).sum(0))
        grads["weigh"] = np.einsum("tba,tb->a", looked, at_pull)
        at_looked = at_pull[:, :, None] * w["weigh"] * (1 - looked * looked)
        grads["look"] = np.einsum("tbh,tba->ha", states, at_looked)
        at_states = at_states + at_looked @ w["look"].T
        at_inputs = np.zeros_like(inputs)
        for k, way in enumerate(("on", "back")):
            own, given, fresh, kept = keep[way]
            back = at_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            back = back[::-1] if way == "back" else back
            grads[f"{way}_state"] = np.zeros_like(own.state)
            gates = gru.retreat(own, kept, fresh, back, grads[f"{way}_state"])
            order = np.argsort(given.ravel(), kind="stable")
            seen = given.ravel()[order]
            first = np.flatnonzero(np.diff(seen, prepend=-1))
            at_gates = np.zeros_like(own.inputs)
            at_gates[seen[first]] = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], first)
            grads[f"{way}_in"] = inputs.T @ at_gates
            grads[f"{way}_bias"] = at_gates.sum(0)
            at_inputs += at_gates @ w[f"{way}_in"].T
        grads["word"] = np.zeros_like(w["word"])
        _add_rows(grads["word"], rows, at_inputs[:, :WORD_SIZE])
        sizes = np.diff(read.ends, prepend=0)
        grads["letters"] = np.zeros_like(w["letters"])
        spread = np.repeat(at_inputs[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0)
        _add_rows(grads["letters"], read.trigrams, spread)
        logs = np.where(target > 0, -np.logaddexp(0, -odds), -np.logaddexp(0, odds))
        return grads, float((logs * weight).sum())

    def odds(self, read: Read) -> np.ndarray:
        """Log-odds of every window."""
        if not len(read.first):
            return np.zeros(0)
        inputs = self.inputs(read, self.rows(read))
        out = np.empty(len(read.first))
        # Windows of a length together: all but texts' last ones are full.
        order = np.argsort(-read.length, kind="stable")
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            out[own] = self.run(inputs, *_lanes(read, own))
        return out


def _add_rows(sums: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each of ``values`` to its row of ``sums``."""
    for k in range(sums.shape[1]):
        sums[:, k] += np.bincount(rows, values[:, k], len(sums))


def _lanes(read: Read, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of windows, a window a column, and the windows' lengths."""
    length = read.length[windows]
    steps = np.arange(length.max())[:, None]
    return read.tokens[read.first[windows] + np.minimum(steps, length - 1)], length


def _part(read: Read, windows: np.ndarray) -> tuple[Read, np.ndarray, np.ndarray]:
    """What of ``read`` some windows need, and their lanes."""
    ids, length = _lanes(read, windows)
    used, ids = np.unique(ids, return_inverse=True)
    last = read.ends[used]
    sizes = last - np.where(used > 0, read.ends[used - 1], 0)
    ends = np.cumsum(sizes)
    place = np.repeat(last - ends, sizes) + np.arange(ends[-1])
    none = read.first[:0]
    own = Read(none, read.hashes[used], read.trigrams[place], ends, none, none, none)
    return own, ids.reshape(-1, len(windows)).astype(np.int32), length


def trained(
    read: Read,
    texts: np.ndarray,
    labels: np.ndarray,
    base: float,
    shift: float,
    least_texts: int = 5,
    epochs: int = 12,
    least_steps: int = 250,
    batch: int = 128,
    rate: float = 0.01,
    seed: int = 1,
) -> Network:
    """A network fitted on windows; ``texts`` is each window's text, ``labels`` each text's label.

    Words in ``least_texts`` texts or more have vectors of their own. In the first quarter of the
    epochs a text is seen by a window of its own drawn at random, then by its highest. Every fourth
    text of a label is kept aside: on these the log-odds are set straight in the end.
    """
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(labels), bool)
    for label in (0, 1):
        aside[np.flatnonzero(labels == label)[3::4]] = True
    fitted = np.flatnonzero(~aside)
    epochs = max(epochs, -(-least_steps * batch // len(fitted)))
    token_text = np.repeat(texts, read.length)
    place = np.repeat(read.first - np.cumsum(read.length) + read.length, read.length)
    word = read.tokens[place + np.arange(len(place))].astype(np.int64)
    pairs = np.unique(word * len(labels) + token_text)
    common = np.bincount(pairs // len(labels), minlength=len(read.hashes)) >= least_texts
    net = Network.new(np.sort(read.hashes[common]), base, shift, seed)
    moments = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in net.weights.items()}
    step, top = 0, None
    bounds = np.searchsorted(texts, np.arange(len(labels) + 1))
    for epoch in range(epochs):
        drawn = bounds[:-1] + (rng.random(len(labels)) * np.diff(bounds)).astype(np.int64)
        if epoch * 4 < epochs:
            chosen = drawn[fitted]
        else:
            if top is None or epoch % 4 == 0:
                top, _ = _highest(net, read, bounds)
            # Texts without the label learn from a drawn window too.
            chosen = np.concatenate([top[fitted], drawn[fitted][labels[fitted] == 0]])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            own, ids, length = _part(read, chosen[at : at + batch])
            # Now and then a known word is read by its letters alone.
            rows = np.where(rng.random(len(own.hashes)) < 0.1, 0, net.rows(own))
            inputs = net.inputs(own, rows)
            target = labels[texts[chosen[at : at + batch]]]
            weight = np.full(len(target), 1 / len(target))
            grads, _ = net.gradients(own, rows, inputs, ids, length, target, weight)
            step += 1
            for n, g in grads.items():
                p, (m, v) = net.weights[n], moments[n]
                g = g - 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    _, odds = _highest(net, read, bounds)
    net.scale, net.shift = _straightened(odds[aside], labels[aside], net.shift)
    return net


def _highest(net: Network, read: Read, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's window of the highest log-odds, and these."""
    odds = net.odds(read)
    best = np.maximum.reduceat(odds, bounds[:-1])
    reached = np.flatnonzero(odds == np.repeat(best, np.diff(bounds)))
    text = np.searchsorted(bounds, reached, side="right") - 1
    return reached[np.unique(text, return_index=True)[1]], best


def _straightened(odds: np.ndarray, labels: np.ndarray, shift: float) -> tuple[float, float]:
    """Scale and shift under which log-odds fit labels not learned from, by Newton's method."""
    x = np.stack([odds, np.ones(len(odds))], 1)
    # A pull towards the log-odds as they are, for few texts.
    fit, prior = np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    if len(np.unique(labels)) == 2:
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(x @ fit, -60, 60)))
            slope = x.T @ (labels - chance) - prior @ (fit - [1.0, 0.0])
            bend = (x * (chance * (1 - chance))[:, None]).T @ x + prior
            fit = fit + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(max(fit[0], 1e-3)), float(fit[1] + shift)


def _pieces(chunk: Chunk) -> Iterator[tuple[Chunk, bool]]:
    """A chunk, or a long text in pieces that begin where its next window begins."""
    if chunk.docs > 1 or len(chunk.data) <= 2 * PIECE_BYTES:
        yield chunk, True
        return
    at, size, n = 0, PIECE_BYTES, len(chunk.data)
    while True:
        last = min(at + size, n)
        bounds = np.array([0, last - at])
        piece = Chunk(chunk.first, chunk.data[at:last], chunk.raw[at:last], bounds)
        words = piece.tokens(_LETTER[piece.data])
        windows = (int(words.counts[0]) - 1 - WINDOW) // STRIDE + 1
        if last == n:
            yield piece, True
            return
        if windows < 1:
            size *= 2  # a single word of this length
            continue
        yield piece, False
        at, size = at + int(words.starts[windows * STRIDE]), PIECE_BYTES


def _sampled(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of labelled texts as texts; of a long one ``most``, evenly over its length."""
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            rows, found = [], []
            words = chunk.tokens(_LETTER[chunk.data])
            for d, n in enumerate(words.counts):
                starts = np.arange(0, max(n - WINDOW + STRIDE, min(n, 1)), STRIDE)
                if len(starts) > most:
                    starts = starts[np.linspace(0, len(starts) - 1, most).astype(np.int64)]
                for s in starts:
                    first = words.bounds[d] + s
                    last = min(first + WINDOW, words.bounds[d + 1]) - 1
                    rows.append(chunk.first + d)
                    found.append(chunk.raw[words.starts[first] : words.ends[last]].tobytes())
            own = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            window = pa.array(found, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own.columns, window], [*own.schema.names, "window"])


def fit(
    learned: DataFrame, labels: DataFrame, per_label: int = 1500, windows_per_text: int = 32
) -> Network:
    """A network from texts (doc_id, text) and labels (doc_id, label 0 or 1).

    ``per_label`` bounds the sample: about that many ids of each label, chosen by hash, and twice as
    many at most; of a text at most ``windows_per_text`` windows, evenly over its length, are kept.
    The sample's log-odds are moved by what its labels' shares differ from those of all labelled
    rows. Without rows of both labels every text has the share of label 1.
    """
    own = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = learned.select("doc_id").join(own, "doc_id")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        base = float(np.log(ones + 1e-6) - np.log(zeros + 1))
        return Network(np.zeros(0, np.uint64), base)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chance = F.when(F.col("label") == 1, per_label * (1 << 30) // ones)
    chosen = own.where(draw < chance.otherwise(per_label * (1 << 30) // zeros)).limit(4 * per_label)
    sample = (
        learned.join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("doc_id", "text").alias("draw"), "label", "text")
        .mapInArrow(partial(_sampled, windows_per_text), "draw long, label int, window string")
        .limit(4 * per_label * windows_per_text)
        .toArrow()
    )
    sample = sample.combine_chunks()
    key = sample.column("draw").to_numpy()
    order = np.argsort(key, kind="stable")
    _, first, texts = np.unique(key[order], return_index=True, return_inverse=True)
    label = sample.column("label").to_numpy()[order][first]
    if len(np.unique(label)) < 2:
        return Network(np.zeros(0, np.uint64), float(np.log(ones / zeros)))
    windows = pa.chunked_array(sample.column("window").take(pa.array(order))).combine_chunks()
    read = _one_read(windows)
    drawn = np.bincount(label, minlength=2)
    shift = float(np.log(ones / zeros) - np.log(drawn[1] / drawn[0]))
    return trained(read, texts, label, float(np.log(ones / zeros)), shift)


def _one_read(windows: pa.Array) -> Read:
    """All windows as one, read chunk by chunk; each is a document of its own."""
    parts = [Read.of(chunk) for chunk in chunks(windows)]
    hashes, first, words = np.unique(
        np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True
    )
    sizes = np.concatenate([np.diff(p.ends, prepend=0) for p in parts])
    last = np.cumsum(sizes)[first]
    ends = np.cumsum(sizes[first])
    place = np.repeat(last - ends, sizes[first]) + np.arange(ends[-1] if len(ends) else 0)
    words_before = np.cumsum([0, *(len(p.hashes) for p in parts)])
    tokens_before = np.cumsum([0, *(len(p.tokens) for p in parts)])
    return Read(
        np.concatenate([words[p.tokens + n] for p, n in zip(parts, words_before, strict=False)])
        .astype(np.int32),
        hashes,
        np.concatenate([p.trigrams for p in parts])[place],
        ends,
        np.concatenate([p.first + n for p, n in zip(parts, tokens_before, strict=False)]),
        np.concatenate([p.length for p in parts]),
        np.concatenate([p.windows for p in parts]),
    )


def _scored(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net: Network = shared.value
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            best = np.full(chunk.docs, -np.inf)
            for piece, whole in _pieces(chunk) if net.weights else ():
                read = Read.of(piece, whole)
                odds = net.odds(read) * net.scale + net.shift
                held = np.flatnonzero(read.windows)
                starts = (np.cumsum(read.windows) - read.windows)[held]
                if len(held):
                    best[held] = np.maximum(best[held], np.maximum.reduceat(odds, starts))
            odds = np.where(np.isfinite(best), best, net.base)
            rows = batch.drop_columns(["text"]).slice(chunk.first, chunk.docs)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -60, 60))))],
                [*rows.schema.names, "score"],
            )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    **options,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``training`` tells which rows may be learned from (null counts as not), if ``labels`` (the same
    id and ``label_col``) has a 0 or 1 for their id; of several labels of an id the highest counts.
    The score looks at the text alone: every window of it, however long it is. ``options`` go to
    ``fit``.

    A null or empty text, or one without a letter, has no window and scores as the share of label 1
    among the labelled rows. With one label alone or none, so does every text. Null ids and repeated
    rows are scored like any other. Other columns are ignored. An empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    learn = F.coalesce(training, F.lit(False))
    learned = docs.where(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    net = fit(learned, known.where(F.col("label").isin(0, 1)), **options)
    sent = spark.sparkContext.broadcast(net)
    source = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), (~learn).alias("held_out")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(
        partial(_scored, sent), f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
