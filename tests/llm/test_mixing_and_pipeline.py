"""The mixture's schedule, and the pipeline's stages against their operators' plain versions."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lines import plain_lines
from tests.llm.test_pairs import plain_components, plain_contamination
from tidemark.llm import pfair


def test_no_source_is_a_block_ahead_or_behind():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randint(1, 60)
        weights = {f"s{k}": rng.random() ** rng.choice([1, 4, 9]) for k in range(n)}
        parts = pfair.parts_of(weights, 200)
        assert sum(parts.values()) == 200 and min(parts.values()) >= 1
        seen = Counter()
        for slot, (source, block) in enumerate(pfair.schedule(parts), 1):
            assert block == seen[source]
            seen[source] += 1
            assert all(abs(seen[k] - slot * p / 200) < 1 for k, p in parts.items())
    assert pfair.parts_of({}) == {} == pfair.parts_of({"a": 0})
    with pytest.raises(ValueError):
        pfair.parts_of({str(k): 1 for k in range(9)}, 8)


@pytest.mark.parametrize(
    "weights", [{"hot": 0.5} | {f"s{k}": 0.5 / 9 for k in range(9)}, {"hot": 7.3} | {f"s{k}": 0.37 for k in range(19)}]
)
def test_deviation_from_the_weights_does_not_grow(weights):
    whole, total = pfair.whole(weights), sum(Fraction(w) for w in weights.values())
    assert all(Fraction(n, sum(whole.values())) == Fraction(weights[k]) / total for k, n in whole.items())
    slots = 30_000
    found = pfair.timetable(whole, {k: int(slots * Fraction(w) / total) + 2 for k, w in weights.items()})
    for k, n in whole.items():
        seen = np.searchsorted(found[k], np.arange(slots), side="right").tolist()
        size = sum(whole.values())
        assert all(abs(have * size - slot * n) < size for slot, have in enumerate(seen, 1))


def test_mixture_keeps_to_the_given_weights(table):
    rows = [(k, "x" * 9, None, f"s{k % 12}" if k % 2 else "hot") for k in range(2400)]
    weights = {"hot": 0.5} | {f"s{k}": 0.1 for k in range(1, 12, 2)}
    found = pfair.mixed(table(rows), weights, block_chars=20, period=20)
    hot = sorted(r.slot for r in found.where("source = 'hot'").select("slot").distinct().collect())
    share = 0.5 / 1.1
    assert all(abs(n - share * slot) < 1 for n, slot in enumerate(hot))


def test_more_sources_than_a_period_has_slots(table):
    rows = [(k, "x" * 30, None, f"host{k % 1500}" if k % 3 else "hot") for k in range(3000)]
    found = pfair.mixed(table(rows), block_chars=40).collect()
    assert sorted(r.position for r in found) == list(range(3000))
    assert len({(r.source, r.block) for r in found}) == len({r.slot for r in found})


def mixed_rows(words):
    rng = random.Random(6)
    sources = ["big"] * 6 + ["a", "b", None]
    rows = [(k, " ".join(words(rng.randint(0, 60))), None, rng.choice(sources)) for k in range(200)]
    rows += [(300, None, None, "a"), (301, "", None, ""), (None, "x", None, "b"), rows[3], rows[3]]
    return rows + [(302, " ".join(words(3000)), None, "a"), (303, "later", None, "unlisted")]


@pytest.mark.parametrize("weights", [None, {"big": 1, "a": 5, "b": 2, "": 1, "absent": 1}])
def test_mixture_holds_every_row_and_the_weights(table, words, weights):
    rows = mixed_rows(words)
    found = pfair.mixed(table(rows), weights, block_chars=400, period=20).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert sorted(r.position for r in found) == list(range(len(rows)))
    in_order = sorted(found, key=lambda r: r.position)
    slots = [1 << 40 if r.slot is None else r.slot for r in in_order]
    assert slots == sorted(slots)
    behind = {r.source for r in found if r.slot is None}
    assert behind == (set() if weights is None else {"unlisted"})
    by_slot = {}
    for r in found:
        if r.slot is not None:
            by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(blocks) == 1 for blocks in by_slot.values())
    begins = Counter()
    for r in sorted(found, key=lambda r: (r.source, r.block, r.position)):
        assert begins[r.source] // 400 >= r.block
        begins[r.source] += len(dict((i, t) for i, t, *_ in rows)[r.doc_id] or "") + 1


def test_mixture_of_nothing(table):
    assert pfair.mixed(table([(1, "a", None, "s")]).where("false")).count() == 0
    (one,) = pfair.mixed(table([(1, "a", None, "s")]), {}).collect()
    assert (one.position, one.slot, one.on_target) == (0, None, False)


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    """A folder of small tables with low quality, copied lines, near copies and leaked items."""
    rng = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(k, " ".join(words(20))) for k in range(5)]
    long_line = [" ".join(words(12)) for _ in range(4)]
    rows, labels = [], []
    for k in range(120):
        w = words(90)
        if k % 6 == 0:
            w = [x + "##" for x in w]
        if k % 15 == 1:
            w[30:30] = items[k % 5][1].split()
        lines = [" ".join(w[i : i + 15]) for i in range(0, len(w), 15)]
        if k % 4 == 1:
            lines.insert(2, rng.choice(long_line))
        rows.append((k, "\n".join(lines), "en", f"s{k % 3}"))
        labels.append((k, int(k % 6 != 0)))
    near = rows[2][1].split("\n")
    near = "\n".join(line + " " + words(1)[0] for line in near)
    rows += [(200, rows[2][1], "en", "s1"), (201, near, "en", None), (201, near, "en", None)]
    rows += [(202, near + " more", None, "s0"), (203, None, "en", "s0"), (None, rows[4][1] + " x", "en", "s0")]
    full = [(*r, None if r[1] is None else len(r[1]), "extra") for r in rows]
    fields = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    spark.createDataFrame(full, fields).write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    marks.withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, corpus, folder):
    sf_dir, rows, items = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        after = [(r.doc_id, r.text) for r in docs.collect()]
        texts[name] = after
        ids = sorted((str(i) for i, _ in after))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality rules":
            assert ids == sorted(str(i) for i, t, *_ in rows if t is not None and "##" not in t)
        if name == "line dedup":
            unique = list({(i, t): None for i, t in before})
            drops = {i: d for i, d, _ in plain_lines(unique)}
            for i, t in after:
                own = next(x for j, x in before if j == i).split("\n")
                assert t == "\n".join(x for at, x in enumerate(own) if at not in drops[str(i)])
            assert "200" not in ids and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "n-gram Jaccard join":
            groups = plain_components([b for b in before if b[0] is not None], 5, 80)
            want = {i for i, (_, root) in groups.items() if i == root}
            assert ids == sorted([*map(str, want), *(["None"] if None in dict(before) else [])])
        if name == "benchmark decontamination":
            assert ids == sorted(str(i) for i, t in before if not plain_contamination(t, items)[4])
        if name == "mixing to target weights":
            assert sorted(before, key=str) == sorted(after, key=str)
            assert sorted(r.position for r in docs.collect()) == list(range(len(after)))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
