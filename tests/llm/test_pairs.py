"""The Jaccard join and decontamination against plain versions over small corpora."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import ngram_jaccard
from tidemark.llm.bytescan import chunks
from tidemark.llm.components import components
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.ngram_jaccard import jaccard_components


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(words):
    rng = random.Random(3)
    base = words(120)
    rows = []
    for k in range(40):  # near copies, some on either side of the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = words(1)[0]
        rows.append(" ".join(copy))
    passage = " ".join(words(30))
    rows += [" ".join(words(8)) + " " + passage for _ in range(12)]
    rows += ["The cat", "the CAT", "the\tcat ", "one", "One", "", " \n ", "É é", "é é", None]
    rows += [" ".join(words(2000))] * 2
    rows += [" ".join(words(60)) for _ in range(10)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_plain_version(table, words):
    rows = corpus(words)
    for width, percent in ((3, 90), (5, 80)):
        got = {
            r.doc_id: (r.n_shingles, r.component_id)
            for r in jaccard_components(table(rows), width=width, percent=percent).collect()
        }
        assert got == plain_components(rows, width, percent)


def test_null_ids_and_repeated_rows(table):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (9, None)]
    got = sorted(
        jaccard_components(table(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id)
    )
    assert [tuple(r) for r in got] == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9), (None, 2, None)]


def test_empty_tables(table):
    empty = table([(1, "a")]).where("false")
    assert jaccard_components(empty).count() == 0
    benchmark = table([(1, "a")]).selectExpr("doc_id AS item_id", "text")
    assert decontaminated(empty, benchmark).count() == 0
    clean = decontaminated(table([(1, "a")]), benchmark.where("false")).first()
    assert (clean.n_words, clean.n_hit, clean.contaminated) == (1, 0, False)


def test_word_hashes_follow_the_bytes_alone():
    texts = ["the Cat  sat", None, "", "cat\nthe", "é É", "x" * 3000, "sat"]
    found = {}
    for size in (8, 1 << 20):
        for chunk in chunks(pa.array(texts), size):
            words = chunk.words()
            for a, b, h in zip(words.starts, words.ends, words.hashes(), strict=True):
                found.setdefault(chunk.data[a:b].tobytes(), set()).add(int(h))
    assert set(found) == {w for t in texts if t for w in t.encode().lower().split()}
    assert all(len(h) == 1 for h in found.values())
    assert len({h for hs in found.values() for h in hs}) == len(found)


def test_prefixes_share_a_token_whenever_sets_are_similar(words):
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(n) < 0.97], rng.integers(0, 1 << 60, 2).astype(np.uint64)]))
        a = np.unique(a)
        shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 10 * shared >= 9 * union:
            for salt in ngram_jaccard._SALTS:
                x, y = (
                    ngram_jaccard._ordered(s, None, salt, ngram_jaccard._prefix_size(len(s), 90))
                    for s in (a, b)
                )
                assert len(np.intersect1d(x, y))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    got = {r.node: r.component for r in found.collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert got == want


def plain_contamination(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lowered(text))
    hit, found = set(), set()
    for item, other in items:
        w = word.findall(lowered(other))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def test_decontamination_equals_plain_version(spark, table, words):
    items = [(k, " ".join(words(25))) for k in range(6)]
    items += [(10, items[0][1]), (11, "short one"), (12, "x"), (13, ""), (14, None), (15, "É, DÉ!")]
    rows = [" ".join(words(200)) for _ in range(5)]
    rows += [f"{rows[0]} {items[k][1][3:]} tail" for k in range(4)]
    rows += [items[1][1].upper().replace(" ", ", "), "a Short-ONE b short one", "x", "é dÉ", "", None]
    rows += [" ".join(items[2][1].split()[:12]), " ".join(items[2][1].split()[:9])]
    docs = list(enumerate(rows)) + [(None, items[3][1]), (0, rows[5])]
    benchmark = spark.createDataFrame(items + items[:2] + [(None, "lost")], "item_id long, text string")
    got = decontaminated(table(docs), benchmark).collect()
    shown = sorted(
        (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got
    )
    assert shown == sorted((str(i), *plain_contamination(t, items)) for i, t in docs)
