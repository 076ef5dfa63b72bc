"""The Merkle manifest against a plain one."""

from __future__ import annotations

import zlib
from hashlib import sha256
from itertools import count

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.merkle import leaf_digest, manifest
from tidemark.llm.shared import lower_ascii

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def coded(*values) -> str:
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def lowered(text):
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over ``nodes`` and every node's (left, right) siblings by level."""
    proofs: list[list] = [[] for _ in nodes]
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for leaf, at in enumerate(own):
            run, k = runs[at // 8], at % 8
            proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            own[leaf] = at // 8
        nodes = [digest("".join(run)) for run in runs]
    return nodes[0], proofs


def plain(rows) -> list[tuple]:
    trees: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = coded(doc_id, source, lang, n_chars, text)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        now = coded(doc_id, source, lang, n_chars, lowered(text) if changed else text)
        order = (doc_id is not None, doc_id or 0, leaf)
        trees.setdefault((lang is not None, (lang or "").encode()), []).append((order, leaf, now))
    names = sorted(trees)
    inner = {name: climb([leaf for _, leaf, _ in sorted(trees[name])]) for name in names}
    root, outer = climb([inner[name][0] for name in names])
    found = []
    for name, over in zip(names, outer, strict=True):
        for (order, leaf, now), proof in zip(sorted(trees[name]), inner[name][1], strict=True):
            whole = [*proof, *over]
            for left, right in whole:
                now = digest(left + now + right)
            doc_id = order[1] if order[0] else None
            text = "".join(a + b for a, b in whole)
            found.append((doc_id, leaf, inner[name][0], root, digest(text), now, now == root))
    return found


def run(docs):
    columns = [F.col(f) for f in FIELDS]
    slot = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    altered = leaf_digest(*columns[:-1], lower_ascii(F.col("text")))
    found = manifest(docs, found=F.when(slot == 0, altered).otherwise(leaf_digest(*columns)))
    return [tuple(r) for r in found.collect()]


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def rows_of(sizes: dict, ids=None):
    ids = ids or count()
    return [
        (next(ids), f"Text {k} Größe Ä\x00" if k % 3 else f"low {k}", lang, f"src{k % 2}")
        for lang, n in sizes.items()
        for k in range(n)
    ]


@pytest.mark.parametrize(
    "sizes",
    [
        {"en": 1},
        {None: 1, "en": 9, "de": 8, "z": 65, "é": 2},
        {f"l{k}": 1 + k for k in range(70)},
    ],
)
def test_equals_plain_manifest(table, sizes):
    rows = rows_of(sizes)
    want = plain([(*r, len(r[1])) for r in rows])
    assert sorted(run(table(rows)), key=key) == sorted(want, key=key)
    assert any(not r[-1] for r in want) or len(rows) == 1


def test_several_sweeps(table, monkeypatch):
    # Small blocks, so that trees of a few hundred leaves pass through three tables.
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = rows_of({"en": 600, "de": 64, None: 1, **{f"x{k}": 1 for k in range(20)}})
    want = plain([(*r, len(r[1])) for r in rows])
    assert sorted(run(table(rows)), key=key) == sorted(want, key=key)


def test_a_block_is_swept_with_few_digests_held(monkeypatch):
    held = []
    push = merkle.heapq.heappush

    def counted(queue, item):
        push(queue, item)
        held.append(len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", counted)
    leaves = [digest(str(k)) for k in range(4000)]
    swept = merkle._swept(({"index": k, "digest": h} for k, h in enumerate(leaves)), 4)
    assert swept == climb(leaves)[0]
    assert max(held) <= 8 * 4


def test_nulls_ties_and_long_texts(table):
    same = [(7, "Same Row", "en", "a")] * 30
    odd = [
        (None, None, None, None),
        (None, "", None, None),
        (3, None, "en", None),
        (6, "", "en", ""),
        (6, "OTHER text of the same id", "en", ""),
        (9, "LONG " * 400_000, "de", "a"),
    ]
    rows = same + odd
    want = plain([(*r, None if r[1] is None else len(r[1])) for r in rows])
    assert sorted(run(table(rows)), key=key) == sorted(want, key=key)


def test_empty_table(table):
    found = manifest(table([]))
    assert found.columns[:4] == ["doc_id", "leaf", "subroot", "root"] and found.count() == 0
