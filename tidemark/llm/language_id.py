"""Language identification in two steps: the family first, then languages within it, pair by pair.

A text is seen as the mean of its hashed letter bigrams and trigrams, so a linear model's margin is
a sum of weights over positions, taken for whole batches at once. Families are told apart by linear
support vector machines, one per family against the rest. Within the winning family, one machine per
pair of languages votes. All machines are fitted on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Chunk, chunks
from tidemark.llm.shared import small_batches

# The family of each language by ISO 639-1 code. Any other is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl no sv".split(),
    "romance": "ca es fr gl it pt ro".split(),
    "slavic": "bg cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "semitic": "ar he mt".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}

UNKNOWN = "und"
DIM_BITS = 12

# Bytes as seen by the models: letters of ASCII in lower case, bytes of longer characters as they
# are, and a space for anything else.
_SEEN = np.full(256, 0x20, np.uint8)
_SEEN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Grams:
    """Feature ids of a chunk's documents, two per position, and where documents begin."""

    pairs: np.ndarray
    triples: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def _grams(chunk: Chunk) -> Grams:
    """Each document is read with a space before and two after it."""
    sizes = np.diff(chunk.offsets)
    padded = np.full(len(chunk.raw) + 3 * chunk.docs, 0x20, np.uint32)
    at = np.arange(len(chunk.raw)) + np.repeat(3 * np.arange(chunk.docs) + 1, sizes)
    seen = _SEEN[chunk.raw]
    # Latin-1 capitals are C3 80 .. C3 9E in UTF-8, their small forms 20 higher.
    after = np.zeros(len(seen), bool)
    after[1:] = seen[:-1] == 0xC3
    seen = np.where(after & (seen >= 0x80) & (seen <= 0x9E) & (seen != 0x97), seen + 0x20, seen)
    padded[at] = seen
    starts = chunk.offsets[:-1] + 3 * np.arange(chunk.docs)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    used = (a != 0x20) | (b != 0x20)
    scale, shift = np.uint32(0x9E3779B1), np.uint32(32 - DIM_BITS)
    blank = np.int64(2 << DIM_BITS)  # a feature whose weights are zero
    pairs = np.where(used, ((a | b << 8 | 0x01000000) * scale >> shift).astype(np.int64), blank)
    triples = ((a | b << 8 | c << 16) * scale >> shift).astype(np.int64) + (1 << DIM_BITS)
    triples = np.where(used, triples, blank)
    counts = np.add.reduceat(used.astype(np.int64), starts) if chunk.docs else sizes
    return Grams(pairs, triples, starts, np.maximum(counts, 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse mean features of labelled documents."""
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            g = _grams(chunk)
            ids, values = [], []
            for d in range(chunk.docs):
                last = g.starts[d + 1] if d + 1 < chunk.docs else len(g.pairs)
                own = slice(g.starts[d], last)
                both = np.concatenate([g.pairs[own], g.triples[own]])
                found, n = np.unique(both[both < 2 << DIM_BITS], return_counts=True)
                ids.append(found.astype(np.int32))
                values.append((n / g.counts[d]).astype(np.float32))
            langs = batch.column("lang").slice(chunk.first, chunk.docs)
            yield pa.RecordBatch.from_arrays(
                [langs, pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["lang", "ids", "means"],
            )


def _machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated gradient steps.

    The weights are a sum of rows at every step, so the steps are taken on the rows' shares.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    gram = (x @ x.T).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 1.0 / (2 * float((weight * np.diag(gram)).sum()) + penalty)
    share = ahead = np.zeros(len(x))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (gram @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * weight * y * slack)
        share, ahead = step, step + k / (k + 3) * (step - share)
    return share.astype(np.float32) @ x


@dataclass
class Languages:
    """Languages with a training row, their families, and the machines' weights as columns."""

    langs: list[str]
    families: list[list[int]]
    duels: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of machine margins (families first, then duels)."""
        rows = np.arange(len(margins))
        chance = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        n = len(self.families) if len(self.families) > 1 else 0
        family = margins[:, :n].argmax(1) if n else np.zeros(len(margins), np.int64)
        score = chance[rows, family] if n else np.ones(len(margins))
        lang = np.zeros(len(margins), np.int64)
        for f, members in enumerate(self.families):
            own = np.flatnonzero(family == f)
            votes = np.zeros((len(own), len(self.langs)))
            worst = np.ones((len(own), len(self.langs)))
            for k, (a, b) in enumerate(self.duels, n):
                if a in members:
                    p = chance[own, k]
                    # One vote per duel, and the margin to decide between equal votes.
                    votes[:, a] += (p >= 0.5) + p / 1e3
                    votes[:, b] += (p < 0.5) + (1 - p) / 1e3
                    worst[:, a] = np.minimum(worst[:, a], p)
                    worst[:, b] = np.minimum(worst[:, b], 1 - p)
            won = np.array(members)[votes[:, members].argmax(1)]
            lang[own] = won
            score[own] *= worst[np.arange(len(own)), won]
        return lang, score


def fit(labelled: DataFrame, per_language: int = 300, families: Mapping = FAMILIES) -> Languages:
    """Machines from (doc_id, text, lang), all non-null in lang.

    ``per_language`` bounds the sample: about that many rows of each language, chosen by a hash of
    the id, with whole texts; twice as many rows in all is a hard limit.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    kind = {m: name for name, members in families.items() for m in members}
    groups: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        groups.setdefault(kind.get(lang, lang), []).append(k)
    members = [groups[name] for name in sorted(groups)]
    duels = [pair for group in members for pair in combinations(group, 2)]
    dims = (2 << DIM_BITS) + 1
    if len(langs) < 2:
        return Languages(langs, members, duels, np.zeros((dims, 0)), np.zeros(0))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang in langs:
        chosen |= (F.col("lang") == lang) & (draw < per_language * (1 << 30) // sizes[lang])
    sample = (
        labelled.where(chosen)
        .select("text", "lang")
        .limit(2 * per_language * len(langs))
        .mapInArrow(_features, "lang string, ids array<int>, means array<float>")
        .toArrow()
    )
    x = np.zeros((sample.num_rows, dims - 1), np.float32)
    for row, (ids, means) in enumerate(zip(sample["ids"], sample["means"], strict=True)):
        x[row, np.asarray(ids.values)] = np.asarray(means.values)
    y = np.array([langs.index(v) for v in sample["lang"].to_pylist()])
    # Frequent features would drown the others in a squared loss, so they are scaled down.
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    columns = []
    for group in members if len(members) > 1 else []:
        columns.append(_machine(x, np.where(np.isin(y, group), 1.0, -1.0).astype(np.float32)))
    for a, b in duels:
        own = np.isin(y, (a, b))
        columns.append(_machine(x[own], np.where(y[own] == a, 1.0, -1.0).astype(np.float32)))
    weights = np.zeros((dims, len(columns)), np.float32)
    for k, column in enumerate(columns):
        weights[:-1, k] = column[:-1] * scale
    return Languages(langs, members, duels, weights, np.array([c[-1] for c in columns]))


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Languages = shared.value
    columns = [np.ascontiguousarray(model.weights[:, k]) for k in range(model.weights.shape[1])]
    names = np.array([*model.langs, UNKNOWN], object)
    for batch in batches:
        texts = batch.column("text")
        for chunk in chunks(texts):
            g = _grams(chunk)
            margins = np.empty((chunk.docs, len(columns)))
            for k, w in enumerate(columns):
                gained = w[g.pairs] + w[g.triples]
                margins[:, k] = np.add.reduceat(gained, g.starts, dtype=np.float64) / g.counts
                margins[:, k] += model.bias[k]
            ascii_letters = (chunk.data >= ord("a")) & (chunk.data <= ord("z"))
            letters = np.concatenate([[0], np.cumsum(ascii_letters)])[chunk.offsets]
            letter = np.diff(letters) > 0
            for d in np.flatnonzero(~letter):
                text = texts[chunk.first + int(d)].as_py() or ""
                letter[d] = any(c.isalpha() for c in text)
            if not model.langs:
                letter[:] = False
                lang, score = np.zeros(chunk.docs, np.int64), np.zeros(chunk.docs)
            else:
                lang, score = model.predict(margins)
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.slice(chunk.first, chunk.docs) for c in batch.columns[1:]],
                    pa.array(names[np.where(letter, lang, len(names) - 1)], pa.string()),
                    pa.array(np.where(letter, score, 0.0)),
                ],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )


def identify(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``training`` tells which rows may be learned from, if their language is not null; the others are
    held out. Predictions look at the text alone. Text that is null or has no letter is ``und`` with
    score 0; so is everything if there is nothing to learn from. Null ids and repeated rows are
    treated like any other, other columns are ignored, an empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    learn = F.coalesce(training, F.lit(False))
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    model = spark.sparkContext.broadcast(fit(labelled, per_language))
    source = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), (~learn).alias("held_out")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        partial(_predict, model), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
