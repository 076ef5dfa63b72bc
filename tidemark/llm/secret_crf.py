"""Secrets by fixed patterns, and by a linear-chain conditional random field beside them.

The field tags tokens as beginning a secret, inside one or outside, from a token's shape, the words
beside it and figures of its file. It is fitted on windows around what the patterns find and on
windows without any, and decoded by Viterbi. Decoding is exact and still touches few tokens: where
"outside" leads by more than any transitions can make good, the best path goes through "outside", so
the chain falls apart there and only the short stretches in between are decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Chunk, chunks, longs, mix
from tidemark.llm.shared import small_batches, written

ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE,
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: One of these, in lower case, is in every match of ASSIGN.
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

OUTSIDE, BEGIN, INSIDE = 0, 1, 2

_TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-":
    _TOKEN[_c] = True
_TOKEN[0x80:] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

_LETTER = np.zeros(256, np.int8)  # 1 lower, 2 upper, 3 digit, 4 sign, 5 beyond ASCII
_LETTER[ord("a") : ord("z") + 1] = 1
_LETTER[ord("A") : ord("Z") + 1] = 2
_LETTER[ord("0") : ord("9") + 1] = 3
_LETTER[list(b"+/_.-")] = 4
_LETTER[0x80:] = 5
_BESIDE = np.zeros(256, np.int64)  # what stands between tokens
for _k, _group in enumerate((b" ", b"\n\r", b"=", b":", b"\"'", b"\t")):
    _BESIDE[list(_group)] = _k + 1

#: Sizes of the feature groups: shape, mix of classes, word before, word before that, word after,
#: what stands before and after, shape before, the file's figures.
_GROUPS = (512, 64, 1024, 512, 512, 49, 512, 32)
_OFFSETS = np.concatenate([[0], np.cumsum(_GROUPS)[:-1]])
N_FEATURES = int(sum(_GROUPS))
N_KINDS = len(_GROUPS)


def base_spans(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, of what the patterns find."""
    found = []
    low = raw.lower()
    if any(hint in low for hint in _HINTS):
        for m in ASSIGN.finditer(raw):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if b"AKIA" in raw:
        for m in ACCESS.finditer(raw):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    return found


def _chunk_spans(chunk: Chunk) -> list[list[tuple[int, int, int, int, int]]]:
    """Base spans of each document of a chunk, sorted; hexadecimal runs are found all at once."""
    found: list[list] = [[] for _ in range(chunk.docs)]
    whole = chunk.raw.tobytes()
    low = chunk.data.tobytes()
    marked = set()
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            marked.add(int(np.searchsorted(chunk.offsets, at, side="right")) - 1)
            at = low.find(hint, at + 1)
    at = whole.find(b"AKIA")
    while at >= 0:
        marked.add(int(np.searchsorted(chunk.offsets, at, side="right")) - 1)
        at = whole.find(b"AKIA", at + 1)
    for d in marked:
        found[d] += base_spans(whole[chunk.offsets[d] : chunk.offsets[d + 1]])
    starts, ends = chunk.runs(_HEX[chunk.raw])
    long_ones = np.flatnonzero(ends - starts >= MIN_HEX)
    docs = np.searchsorted(chunk.offsets, starts[long_ones], side="right") - 1
    for k, d in zip(long_ones, docs, strict=True):
        a, b = int(starts[k] - chunk.offsets[d]), int(ends[k] - chunk.offsets[d])
        found[d].append((a, 2, b, a, b))
    for own in found:
        own.sort()
    return found


@dataclass
class Tokens:
    """Tokens of a chunk with their feature ids, a column per group."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    features: np.ndarray


def _tokens(chunk: Chunk) -> Tokens:
    words = chunk.tokens(_TOKEN[chunk.raw])
    starts, ends, n = words.starts, words.ends, len(words.starts)
    kinds = _LETTER[chunk.raw]
    counts = []
    for kind in range(1, 6):
        sums = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == kind, out=sums[1:])
        counts.append(sums[ends] - sums[starts])
    turns = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(kinds[1:] != kinds[:-1], out=turns[1 : len(kinds)])
    turns[len(kinds) :] = turns[len(kinds) - 1] if len(kinds) else 0
    size = ends - starts
    changes = turns[ends - 1] - turns[starts]
    length = np.searchsorted([2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 64], size, side="right")
    shape = length * 32
    for bit, c in enumerate(counts):
        shape += (c > 0) << bit
    digits = np.minimum(counts[2] * 8 // np.maximum(size, 1), 7)
    blend = digits * 8 + np.minimum(changes, 7)
    word = (words.hashes() >> np.uint64(40)).astype(np.int64) + 1
    doc = np.repeat(np.arange(chunk.docs), words.counts)

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """Values of the token ``by`` places on in the same document, 0 where there is none."""
        out = np.zeros(n, np.int64)
        if by < 0:
            same = doc[-by:] == doc[:by]
            out[-by:] = np.where(same, values[:by], 0)
        else:
            same = doc[by:] == doc[:-by]
            out[:-by] = np.where(same, values[by:], 0)
        return out

    ahead = np.minimum(ends, max(len(chunk.raw) - 1, 0))
    before = np.where(starts > chunk.offsets[doc], _BESIDE[chunk.raw[np.maximum(starts - 1, 0)]], 0)
    after = np.where(ends < chunk.offsets[doc + 1], _BESIDE[chunk.raw[ahead]], 0)
    total = np.diff(chunk.offsets)
    digit_sums = np.concatenate([[0], np.cumsum(kinds == 3)])[chunk.offsets]
    dense = np.minimum(64 * np.diff(digit_sums) // np.maximum(total, 1), 3)
    file = dense * 8 + np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64) // 2, 7)
    columns = [
        shape,
        blend,
        shifted(word, -1) % 1024,
        shifted(word, -2) % 512,
        shifted(word, 1) % 512,
        before * 7 + after,
        shifted(shape + 1, -1) % 512,
        file[doc],
    ]
    features = np.stack([c + o for c, o in zip(columns, _OFFSETS, strict=True)], 1)
    return Tokens(starts, ends, words.bounds, features.astype(np.int32))


def _labels(tokens: Tokens, chunk: Chunk, d: int, spans) -> np.ndarray:
    """Tags of a document's tokens by the values of its base spans."""
    a, b = tokens.bounds[d], tokens.bounds[d + 1]
    starts = tokens.starts[a:b] - chunk.offsets[d]
    ends = tokens.ends[a:b] - chunk.offsets[d]
    tags = np.zeros(b - a, np.int8)
    for _, _, _, low, high in spans:
        inside = np.flatnonzero((starts < high) & (ends > low))
        tags[inside] = INSIDE
        tags[inside[:1]] = BEGIN
    return tags


def _windows(
    reach: int, batches: Iterator[pa.RecordBatch], bound: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Windows of 2 * reach + 1 tokens, or a whole shorter document: around each value found, and
    one more per document.

    With a ``bound`` so many of each kind are held at most, those with the smallest hash of the
    row's ``draw`` and the place in it. ``n`` sums to the windows of a kind before the bound.
    """
    wide = 2 * reach + 1
    held: dict[bool, list] = {True: [], False: []}
    seen = {True: 0, False: 0}
    cut = dict.fromkeys(held, 1 << 63)
    for batch in batches:
        named = "draw" in batch.schema.names
        draws = batch.column("draw").to_numpy() if named else np.zeros(batch.num_rows, np.int64)
        draws = draws.astype(np.int64).view(np.uint64)
        for chunk in chunks(batch.column(0)):
            tokens = _tokens(chunk)
            for d, spans in enumerate(_chunk_spans(chunk)):
                a, b = int(tokens.bounds[d]), int(tokens.bounds[d + 1])
                if b == a:
                    continue
                own = _labels(tokens, chunk, d, spans)
                # The place of the extra window follows from the text alone.
                spot = int(tokens.features[a:b, 0].sum()) % (b - a)
                centres = np.append(np.flatnonzero(own == BEGIN), spot)
                salted = draws[chunk.first + d] ^ mix(np.arange(1, len(centres) + 1).astype(np.uint64))
                for centre, draw in zip(centres.tolist(), (mix(salted) >> np.uint64(1)).tolist(), strict=True):
                    secret = bool(own[centre] == BEGIN)
                    seen[secret] += 1
                    if draw > cut[secret]:
                        continue
                    first = max(min(max(centre - reach, 0), b - a - wide), 0)
                    part = tokens.features[a + first : min(a + first + wide, b)].ravel()
                    held[secret].append((draw, part, own[first : first + wide].astype(np.int32)))
                    if bound is not None and len(held[secret]) >= 2 * bound:
                        held[secret] = sorted(held[secret], key=lambda w: w[0])[:bound]
                        cut[secret] = held[secret][-1][0]
    for secret in held:
        if bound is not None:
            held[secret] = sorted(held[secret], key=lambda w: w[0])[:bound]
    rows = [(secret, *w) for secret in held for w in held[secret]]
    if rows:
        counts = np.zeros(len(rows), np.int64)
        for secret in held:
            if held[secret]:
                counts[0 if secret else len(held[True])] = seen[secret]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.bool_()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array(counts),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            ],
            ["secret", "draw", "n", "features", "tags"],
        )


_WINDOW_FIELDS = "secret boolean, draw long, n long, features array<int>, tags array<int>"


def drawn(source: DataFrame, max_windows: int, reach: int) -> list[tuple]:
    """(features, tags, weight) of windows from all rows of ``source`` (text, doc_id), by hash.

    Windows around a value get half of the places, and all that the others leave; the others fill
    the rest. Weights restore the proportion of the two kinds in the whole table.
    """
    made = written(
        source.select("text", F.xxhash64("doc_id", "text").alias("draw")).mapInArrow(
            partial(_windows, reach, bound=max_windows), _WINDOW_FIELDS
        )
    )
    seen = {r["secret"]: r["n"] for r in made.groupBy("secret").agg(F.sum("n").alias("n")).collect()}
    secrets, others = (min(seen.get(k, 0), max_windows) for k in (True, False))
    secrets = min(secrets, max(max_windows // 2, max_windows - others))
    taken = []
    for secret, n in ((True, secrets), (False, min(others, max_windows - secrets))):
        if not n:
            continue
        # A little more than n windows are this low; the limit takes exactly n.
        low = (1 << 63) * (n + n // 10 + 100) // seen[secret]
        of_kind = made.where(F.col("secret") == secret)
        of_kind = of_kind.where(F.col("draw") < low) if low < 1 << 63 else of_kind
        got = of_kind.orderBy("draw", "tags", "features").limit(n).select("features", "tags").toArrow()
        weight = seen[secret] / max(got.num_rows, 1)
        for features, tags in zip(got["features"].to_pylist(), got["tags"].to_pylist(), strict=True):
            taken.append((np.array(features).reshape(-1, N_KINDS), np.array(tags), weight))
    return taken


@dataclass
class Field:
    """Weights: features by tag, and transitions from tag to tag."""

    emit: np.ndarray
    move: np.ndarray

    @property
    def lead(self) -> float:
        """How far "outside" must lead for no neighbours to outweigh it."""
        gain = [
            self.move[a, x] + self.move[x, b] - self.move[a, OUTSIDE] - self.move[OUTSIDE, b]
            for a in range(3)
            for b in range(3)
            for x in (BEGIN, INSIDE)
        ]
        return float(max(gain))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expectations(scores: np.ndarray, move: np.ndarray, weights: np.ndarray | None = None):
    """Marginals of tags and of transitions, and the log of the partition, for equal chains.

    Transitions are summed over the chains, times ``weights``."""
    n, length, _ = scores.shape
    ahead = np.empty_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        ahead[:, t] = scores[:, t] + _log_sum(ahead[:, t - 1][:, :, None] + move, 1)
    back = np.zeros_like(scores)
    for t in range(length - 2, -1, -1):
        back[:, t] = _log_sum(move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    tags = np.exp(ahead + back - total[:, None, None])
    pairs = np.zeros((3, 3))
    for t in range(1, length):
        joint = ahead[:, t - 1][:, :, None] + move + (scores[:, t] + back[:, t])[:, None, :]
        found = np.exp(joint - total[:, None, None])
        pairs += found.sum(0) if weights is None else np.tensordot(weights, found, 1)
    return tags, pairs, total


def fit_field(features: np.ndarray, tags: np.ndarray, steps: int = 60, rate: float = 0.3) -> Field:
    """Weights of greatest regularised likelihood: features (n, length, kinds), tags (n, length)."""
    return fit_groups([(features, tags, np.ones(len(features)))] if len(features) else [], steps, rate)


def fit_windows(windows: list[tuple]) -> Field:
    """The field of (features, tags, weight) windows of any length."""
    by_length: dict[int, list] = {}
    for window in windows:
        by_length.setdefault(len(window[1]), []).append(window)
    return fit_groups(
        [tuple(map(np.array, zip(*group, strict=True))) for _, group in sorted(by_length.items())]
    )


def fit_groups(groups: list[tuple], steps: int = 60, rate: float = 0.3) -> Field:
    """As ``fit_field``, over groups (features, tags, weights) of windows of equal length."""
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)))
    size = sum(float(weights.sum()) for _, _, weights in groups)
    true_pairs = np.zeros((3, 3))
    for _, tags, weights in groups:
        to = (tags[:, :-1].ravel(), tags[:, 1:].ravel())
        np.add.at(true_pairs, to, np.repeat(weights, tags.shape[1] - 1))
    seen = [np.full_like(field.emit, 1e-6), np.full_like(field.move, 1e-6)]
    for _ in range(steps if groups else 0):
        grad, pairs = np.zeros_like(field.emit), np.zeros((3, 3))
        for features, tags, weights in groups:
            flat = features.reshape(-1, features.shape[-1])
            scores = field.emit[flat].sum(1).reshape(*features.shape[:2], 3)
            marginals, own_pairs, _ = _expectations(scores, field.move, weights)
            pairs += own_pairs
            error = (np.eye(3)[tags.ravel()] - marginals.reshape(-1, 3))
            error *= np.repeat(weights, tags.shape[1])[:, None]
            for k in range(3):
                weight = np.repeat(error[:, k], flat.shape[1])
                grad[:, k] += np.bincount(flat.ravel(), weight, N_FEATURES)
        for w, g, s in zip(
            (field.emit, field.move), (grad, true_pairs - pairs), seen, strict=True
        ):
            g = g / size - 1e-4 * w
            s += g * g
            w += rate * g / np.sqrt(s)
    return field


def viterbi(scores: np.ndarray, move: np.ndarray, bordered: tuple[bool, bool] = (False, False)):
    """The best tags of one stretch; a border stands for an "outside" token beyond that end."""
    best = scores[0] + (move[OUTSIDE] if bordered[0] else 0)
    came = []
    for row in scores[1:]:
        through = best[:, None] + move
        came.append(through.argmax(0))
        best = through.max(0) + row
    if bordered[1]:
        best = best + move[:, OUTSIDE]
    tags = [int(best.argmax())]
    for back in reversed(came):
        tags.append(int(back[tags[-1]]))
    return np.array(tags[::-1])


def decode(scores: np.ndarray, bounds: np.ndarray, field: Field) -> np.ndarray:
    """Tags of many chains, chain d being rows bounds[d]:bounds[d + 1]."""
    tags = np.zeros(len(scores), np.int8)
    sure = scores[:, OUTSIDE] - scores[:, 1:].max(1) > field.lead
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    chain = np.searchsorted(bounds, open_, side="right") - 1
    cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(chain) > 0)) + 1
    for part in np.split(np.arange(len(open_)), cut):
        a, b, d = open_[part[0]], open_[part[-1]] + 1, chain[part[0]]
        tags[a:b] = viterbi(
            scores[a:b], field.move, (bool(a > bounds[d]), bool(b < bounds[d + 1]))
        )
    return tags


def _crf_spans(tokens: Tokens, tags: np.ndarray, chunk: Chunk) -> dict[int, list[tuple[int, int]]]:
    """Byte spans by document: a begin, or an inside after an outside, and the insides after it."""
    found: dict[int, list[tuple[int, int]]] = {}
    marked = np.flatnonzero(tags)
    docs = np.searchsorted(tokens.bounds, marked, side="right") - 1
    last = -2
    for k, d in zip(marked.tolist(), docs.tolist(), strict=True):
        a, b = int(tokens.starts[k] - chunk.offsets[d]), int(tokens.ends[k] - chunk.offsets[d])
        own = found.setdefault(d, [])
        if own and tags[k] == INSIDE and last == k - 1:
            own[-1] = (own[-1][0], b)
        else:
            own.append((a, b))
        last = k
    return found


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field: Field = shared.value
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            base = _chunk_spans(chunk)
            tokens = _tokens(chunk)
            scores = np.zeros((len(tokens.starts), 3))
            for k in range(N_KINDS):
                scores += field.emit[tokens.features[:, k]]
            extra = _crf_spans(tokens, decode(scores, tokens.bounds, field), chunk)
            counts = np.zeros((3, chunk.docs), np.int64)
            digests, spans = [], []
            for d in range(chunk.docs):
                rows = [(s, k, e) for s, k, e, _, _ in base[d]]
                for s, e in extra.get(d, ()):
                    if all(e <= a or s >= b for a, _, b, _, _ in base[d]):
                        rows.append((s, 3, e))
                if not rows:
                    digests.append(_EMPTY)
                    spans.append("")
                    continue
                rows.sort()
                points = _code_points(chunk.raw[chunk.offsets[d] : chunk.offsets[d + 1]])
                named = [(k, f"{KINDS[k]}:{points[s]}:{points[e]}") for s, k, e in rows]
                for k, _ in named:
                    if k < 3:
                        counts[k, d] += 1
                text = ",".join(t for k, t in named if k < 3)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                spans.append(",".join(t for _, t in named))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(chunk.first, chunk.docs),
                    *[longs(c) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


_EMPTY = hashlib.sha256(b"").hexdigest()


def _code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of characters before it."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_windows: int = 6_000,
    reach: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind; spans
    of kind ``crf`` are the field's, where it finds something that overlaps no pattern's match. A
    pattern's span is its whole match.

    The field is fitted on at most ``max_windows`` windows, chosen from the whole table by a hash of
    id and text, those around secrets first; with no secret in the table it adds nothing. Null text is empty.
    Null ids and repeated rows are scanned like any other, an empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    windows = drawn(source, max_windows, reach)
    if any(tags.any() for _, tags, _ in windows):
        field = fit_windows(windows)
    else:
        field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)))
        field.emit[:, OUTSIDE] = 1.0
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        partial(_scan, spark.sparkContext.broadcast(field)),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
