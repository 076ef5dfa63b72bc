"""Toxicity scores: the network against plain loops, its gradients, and what it learns."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tox
from tidemark.llm.bytescan import chunks
from tidemark.llm.toxicity import Network, Read, toxicity

LABELS = "doc_id long, toxic int, quality int"


def read_of(*texts):
    (chunk,) = chunks(pa.array(texts, pa.string()))
    return Read.of(chunk)


def network(read, seed=4):
    rng = np.random.default_rng(seed)
    net = Network.new(np.sort(read.hashes)[::2], -2.0, 0.1, seed)
    for p in net.weights.values():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return net


def plain_odds(net, inputs, words):
    """Log-odds of one window, word by word."""
    w, size = net.weights, tox.HIDDEN

    def states(rows, way):
        h, out = np.zeros(size), []
        for x in rows:
            g = x @ w[f"{way}_in"] + w[f"{way}_bias"]
            s = h @ w[f"{way}_state"]
            z, r = (1 / (1 + np.exp(-(g[k : k + size] + s[k : k + size]))) for k in (0, size))
            new = np.tanh(g[2 * size :] + r * s[2 * size :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    rows = [inputs[k].astype(float) for k in words]
    both = np.concatenate([states(rows, "on"), states(rows[::-1], "back")[::-1]], 1)
    pull = np.exp(np.tanh(both @ w["look"]) @ w["weigh"])
    return (pull[:, None] * both).sum(0) / pull.sum() @ w["out"] + w["bias"][0]


def test_odds_equal_plain_loops(words):
    texts = [" ".join(words(n)) for n in (1, 5, 31, 32, 33, 48, 49, 130)]
    read = read_of(*texts, "", "12 34")
    net = network(read)
    inputs = net.inputs(read, net.rows(read))
    want = []
    at = 0
    for n in (1, 5, 31, 32, 33, 48, 49, 130):
        own, start = read.tokens[at : at + n], 0
        while True:
            want.append(plain_odds(net, inputs, own[start : start + 32]))
            if start + 32 >= n:
                break
            start += 16
        at += n
    assert np.allclose(net.odds(read), want, atol=1e-4)
    assert read.windows.tolist() == [1, 1, 1, 1, 2, 2, 3, 8, 0, 0]


def test_long_texts_in_pieces(words, monkeypatch):
    text = " ".join(words(3000)) + " " + "x" * 9000 + " " + " ".join(words(70)) + " É."
    read = read_of(text)
    whole = np.sort(network(read).odds(read))
    net = network(read)
    monkeypatch.setattr(tox, "PIECE_BYTES", 4096)
    (chunk,) = chunks(pa.array([text]))
    parts = [Read.of(piece, whole) for piece, whole in tox._pieces(chunk)]
    assert len(parts) > 4
    assert np.allclose(np.sort(np.concatenate([net.odds(p) for p in parts])), whole, atol=1e-5)


def test_gradients(words):
    read = read_of(*[" ".join(words(n)) for n in (3, 40, 12)])
    net = network(read)
    for p in net.weights:
        net.weights[p] = net.weights[p].astype(np.float64)
    rows = net.rows(read)
    ids, length = tox._lanes(read, np.arange(len(read.first)))
    target, weight = np.array([1, 0, 1, 0])[: len(length)], np.full(len(length), 0.5)

    def value():
        return net.gradients(read, rows, net.inputs(read, rows), ids, length, target, weight)

    grads, _ = value()
    rng = np.random.default_rng(0)
    for name, p in net.weights.items():
        filled = np.argwhere(grads[name] != 0)
        for at in filled[rng.choice(len(filled), 3)]:
            at = tuple(at)
            p[at] += 1e-2
            up = value()[1]
            p[at] -= 2e-2
            down = value()[1]
            p[at] += 1e-2
            assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=2e-4), name


def planted(words, n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        text = words(rng.choice([4, 30, 90]))
        bad = k % 3 == 0
        if bad:
            text[rng.randrange(len(text))] = "zzugh" + rng.choice(words(3))
        docs.append((k, " ".join(text), "en", "a"))
        labels.append((k, int(bad), 0))
    return docs, labels


def test_learns_from_labelled_rows_and_scores_all(spark, table, words):
    docs, labels = planted(words)
    far = (1000, " ".join(words(4000) + ["zzughan"] + words(4000)), None, None)
    clean = (1001, " ".join(words(300)), None, None)
    odd = [(1002, None), (1003, ""), (1004, "12 -- 7"), (None, "zzughan it ed"), (1000, far[1])]
    known = spark.createDataFrame(labels + [(1, None, 1), (9999, 1, 1), (3, 0, 0)], LABELS)
    found = toxicity(table([*docs, far, clean, *odd]), known, F.col("doc_id") % 4 != 2)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(docs) + 7
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert r["held_out"] == (r["doc_id"] % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    right = sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    assert right >= 0.9 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1000]["predicted"] == 1 and by_id[None]["predicted"] == 1
    assert by_id[1001]["predicted"] == 0
    base = {by_id[k]["score"] for k in (1002, 1003, 1004)}
    assert len(base) == 1 and 0.3 < base.pop() < 0.37
    assert by_id[None]["held_out"]


@pytest.mark.parametrize("labels", [[], [(1, 0, 1), (3, 0, 1)], [(1, None, 1)]])
def test_without_both_labels(spark, table, labels):
    known = spark.createDataFrame(labels, LABELS)
    found = toxicity(table([(1, "some text"), (3, None)]), known, F.lit(True)).collect()
    assert [r["predicted"] for r in found] == [0, 0]

def test_ones_alone_score_one(spark, table):
    known = spark.createDataFrame([(1, 1, 1)], LABELS)
    found = toxicity(table([(1, "a b"), (2, "c")]), known, F.lit(True)).collect()
    assert all(r["predicted"] == 1 for r in found)


def test_empty_table(spark, table):
    known = spark.createDataFrame([], LABELS)
    assert toxicity(table([]), known, F.lit(True)).count() == 0
