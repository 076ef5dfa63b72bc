"""Language identification, quality rules, secrets and language models on small corpora."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import gru, lm_scoring, secret_crf
from tidemark.llm.decision_list import Condition, describe, judged, learn, learned, statistics
from tidemark.llm.language_id import identify
from tidemark.llm.lm_scoring import lm_scores

TONGUES = {
    "en": "the and ing er on es".split(),
    "de": "der und ung sch ein ü".split(),
    "fr": "le et ment eau ou é".split(),
    "es": "el y ción os ar ñ".split(),
}


def test_languages(table, words):
    rows = [
        (k * 4 + i, " ".join(words(30, parts)).capitalize(), lang)
        for k in range(40)
        for i, (lang, parts) in enumerate(TONGUES.items())
    ]
    odd = [(900, None, "en"), (901, "12 -- !!", "en"), (902, "", None), (None, rows[1][1], None)]
    odd += [(903, rows[0][1], None), (903, rows[0][1], "en"), (904, rows[2][1] * 300, None)]
    found = identify(table(rows + odd), F.col("doc_id") % 5 != 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r)
    wrong = [(i, lang, got[i][0]) for i, _, lang in rows if got[i][0].lang_pred != lang]
    assert len(wrong) <= 3, wrong
    assert {got[i][0].lang_pred for i in (900, 901, 902)} == {"und"}
    assert got[None][0].lang_pred == "de" and got[None][0].held_out
    assert [r.lang_pred for r in got[903]] == ["en", "en"] and got[904][0].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    unlearned = identify(table(rows[:2]), F.lit(False)).collect()
    assert [(r.lang_pred, r.score) for r in unlearned] == [("und", 0.0)] * 2
    assert identify(table(rows).where("false"), F.lit(True)).count() == 0


def plain_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        covered |= {i, i + 1, i + 2} if times[x] > 1 else set()
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_version(table, words):
    texts = [None, "", " \n ", "a b c a b c a", "x x x x", "é ü\né ü\n \n \né ü", "a|b <#> 100%"]
    texts += [" ".join(words(40, ["a", "b"])) for _ in range(5)] + [" ".join(words(3000))]
    rows = list(enumerate(texts)) + [(None, "a"), (3, "a b c a b c a")]
    found = statistics(table(rows)).collect()
    got = sorted(
        (str(r.doc_id), *[r.stats[k] for k in range(5)]) for r in found
    )
    assert got == sorted((str(i), *plain_statistics(t)) for i, t in rows)


def test_rules_are_learned_and_applied(spark, table, words):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        w = words(80)
        kind = k % 4
        if kind == 0:
            w = [x + rng.choice(["###", "$$", "%"]) for x in w]
        if kind == 1 and k % 8 == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, 0 if kind == 0 or k % 8 == 1 else 1))
    labels += [(0, 1), (None, 0), (1, None), (10_000, 0)]
    rows += [(700, None), (None, rows[0][1]), (701, "short"), (0, rows[0][1])]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    measured = statistics(table(rows))
    rules = learned(measured, marks)
    assert 1 <= len(rules) <= 4 and describe(rules)[-1] == "good otherwise"
    kept = {}
    for r in judged(measured, rules).collect():
        kept.setdefault(r.doc_id, set()).add(r.kept)
    wrong = sum(kept[i] != {q == 1} for i, q in labels[:600])
    assert wrong <= 6
    assert kept[700] == kept[701] == kept[None] == {False}
    assert learned(measured, marks.where("false")) == [] == learned(measured, marks.where("quality = 1"))
    assert judged(statistics(table(rows).where("false")), rules).count() == 0


def test_conjunctions_are_found(spark):
    rows = [
        (k, (float(k % 10), float(k // 10 % 10)), int(k % 10 > 5 and k // 10 % 10 <= 3))
        for k in range(900)
    ]
    df = spark.createDataFrame(rows, "doc_id long, features struct<a:double,b:double>, bad int")
    (rule,) = learn(df, F.col("bad") == 1)
    assert set(rule) == {Condition("a", True, 5.5), Condition("b", False, 3.5)}


def plain_base(text):
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
    )
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()


def secret_rows(words):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        w = words(60)
        if k % 2:
            value = "".join(rng.choices("0123456789abcdef", k=32))
            w.insert(rng.randrange(len(w)), rng.choice(["password=", "api_key: ", 'Token = "']) + value)
        if k % 5 == 0:
            w.insert(7, "AKIA" + "".join(rng.choices("ABCDEFGH0123", k=16)))
        rows.append((k, "é " * (k % 3) + " ".join(w)))
    rows += [(200, None), (201, ""), (202, "token: abc"), (203, "ſecret=abcdefgh toKen=abcdefgh")]
    rows += [(204, "passwordpassword='abcdef'token=x.y/z+=-"), (None, "secret:aaaaaaa")]
    rows += [(205, "a" * 30 + "\n" + "0" * 23 + " AKIA" + "Z" * 15), (1, rows[1][1])]
    return rows


def test_secrets(table, words):
    rows = secret_rows(words)
    found = secret_crf.scan(table(rows)).collect()
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found)
    assert got == sorted((str(i), *plain_base(t)) for i, t in rows)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            assert kind in secret_crf.KINDS and 0 <= int(a) < int(b) <= len(text)
    assert secret_crf.scan(table(rows).where("false")).count() == 0
    plain = secret_crf.scan(table([(1, "nothing here"), (2, None)])).collect()
    assert [r.spans for r in plain] == ["", ""]


def test_field_finds_secrets_it_was_not_shown(words):
    rows = [t for _, t in secret_rows(words)[:150]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows[:100])], ["text"])
    (made,) = secret_crf._windows(10, iter([batch]))
    tags = np.array(made.column("tags").to_pylist())
    features = np.array(made.column("features").to_pylist()).reshape(*tags.shape, -1)
    field = secret_crf.fit_field(features, tags)
    hit = missed = extra = 0
    for chunk in secret_crf.chunks(pa.array(rows[100:])):
        tokens = secret_crf._tokens(chunk)
        scores = field.emit[tokens.features].sum(1)
        got = secret_crf.decode(scores, tokens.bounds, field) > 0
        want = np.concatenate(
            [secret_crf._labels(tokens, chunk, d, s) for d, s in enumerate(secret_crf._chunk_spans(chunk))]
        ) > 0
        hit, missed, extra = hit + (got & want).sum(), missed + (~got & want).sum(), extra + (got & ~want).sum()
    assert hit >= 5 * missed and hit >= 9 * extra and hit > 20


def test_windows_come_from_the_whole_table(table, words):
    rows = [(k, " ".join(words(30))) for k in range(400)] + [(400 + k, " ".join(words(6))) for k in range(5)]
    rows += [(500 + k, " ".join([*words(12), f"password='{'Zx9' * 4}'", *words(12)])) for k in range(3)]
    rows += [(600, "token: abcdefghij klm")]
    docs = table(rows).coalesce(1).select("text", "doc_id")
    taken = secret_crf.drawn(docs, 40, 10)
    assert len(taken) == 40 and sum(t.any() for _, t, _ in taken) >= 4
    assert min(len(t) for _, t, _ in taken) < 21
    other = secret_crf.drawn(docs.repartition(7), 40, 10)
    assert all((f == g).all() and (t == u).all() for (f, t, _), (g, u, _) in zip(taken, other, strict=True))
    assert math.isclose(sum(w for *_, w in taken), 409 + 4)


def test_decoding_and_expectations_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        move = rng.normal(0, 1, (3, 3))
        field = secret_crf.Field(np.zeros((1, 3)), move)
        lengths = [4, 1, 6, 3]
        scores = rng.normal(0, 2, (sum(lengths), 3)) + [3, 0, 0]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        got = secret_crf.decode(scores, bounds, field)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            def worth(path, a=a):
                own = sum(scores[a + i, t] for i, t in enumerate(path))
                return own + sum(move[x, y] for x, y in zip(path, path[1:]))

            paths = list(product(range(3), repeat=b - a))
            best = max(map(worth, paths))
            assert math.isclose(worth(tuple(got[a:b])), best)
            tags, pairs, total = secret_crf._expectations(scores[None, a:b], move)
            weight = np.exp([worth(p) for p in paths])
            assert np.isclose(total[0], np.log(weight.sum()))
            share = sum(w * np.eye(3)[list(p)] for w, p in zip(weight, paths)) / weight.sum()
            assert np.allclose(tags[0], share)
            assert np.isclose(pairs.sum(), b - a - 1)


def test_recurrent_gradients_are_right():
    rng = np.random.default_rng(0)
    w = gru.initial(64, 5, rng.random(64) * 10)
    w = gru.Weights(*[p.astype(np.float64) for p in w.parts()])
    given, targets = rng.integers(0, 64, (4, 3)), rng.integers(0, 64, (4, 3))
    fresh = np.zeros((4, 3), bool)
    fresh[0] = fresh[2, 1] = True
    h = np.zeros((3, 5))
    grads, _, _ = gru.gradients(w, given, fresh, targets, h)
    for p, g in zip(w.parts(), grads.parts(), strict=True):
        for at in np.argsort(-np.abs(g), axis=None)[:3]:
            where = np.unravel_index(at, p.shape)
            kept, ends = p[where], []
            for step in (1e-4, -1e-4):
                p[where] = kept + step
                ends.append(gru.gradients(w, given, fresh, targets, h)[2])
            p[where] = kept
            assert np.isclose(g[where], (ends[0] - ends[1]) / 2e-4, rtol=1e-3)


def test_scores_do_not_depend_on_lanes_and_sum_to_one():
    rng = np.random.default_rng(1)
    w = gru.initial(64, 6, rng.random(64) * 10)
    sizes = rng.integers(1, 50, 30)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(0, 64, bounds[-1])
    found = [
        gru.score(w, gru.Lanes.of(tokens, bounds, width), 3, steps)
        for width, steps in ((1, 7), (5, 32), (64, 3))
    ]
    assert np.allclose(found[0], found[1], rtol=1e-4) and np.allclose(found[0], found[2], rtol=1e-4)
    pairs = np.array([[a, b] for a in range(64) for b in range(64)]).ravel()
    alone = gru.score(w, gru.Lanes.of(pairs, np.arange(0, len(pairs) + 1, 2), 50), 3)
    assert np.isclose(np.exp(alone).sum(), 1, rtol=1e-4)


def test_training_helps():
    rng = np.random.default_rng(2)
    tokens = np.cumsum(rng.integers(1, 3, 6000)) % 32  # the next word follows from the last
    bounds = np.arange(0, 6001, 60)
    w = gru.initial(64, 8, np.bincount(tokens, minlength=64).astype(float))
    lanes = gru.Lanes.of(tokens, bounds, 10)
    before = gru.score(w, lanes, 0).sum()
    for _ in range(12):
        w = gru.train(w, lanes, 0)
    assert gru.score(w, lanes, 0).sum() > 0.6 * before


def test_lm_scores(table, words):
    texts = [" ".join(words(60)) for _ in range(60)] + ["", None, " \n", "The THE the", "unseenword"]
    texts += [" ".join(words(4000))]
    rows = list(enumerate(texts)) + [(None, "the"), (5, texts[5])]
    found = lm_scores(table(rows), F.col("doc_id") % 5 != 1, vocabulary=64, rounds=2).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if i is not None and i % 5 != 1 for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        known = sum(count[w] > 0 for w in ws)
        want.append((str(i), i is None or i % 5 == 1, len(ws), known, total, round(base, 6)))
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in found
    ]
    assert sorted(got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    bare = lm_scores(table(rows[:3]), F.lit(False), vocabulary=64).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in bare)
    assert lm_scores(table(rows).where("false"), F.lit(True), vocabulary=64).count() == 0


def test_all_training_rows_reach_the_recurrent_model(table, words):
    rows = [(k, " ".join(words(20))) for k in range(60)]
    docs = table(rows)
    learned = docs.select(F.col("doc_id").alias("row"), "text")
    counted = lm_scoring.count_words(learned, "text")
    # In one round, leaving out any document changes the weights that all of them give.
    default = lm_scoring.fit(learned, counted, rounds=1).weights.flat()
    whole = lm_scoring.fit(learned, counted, rounds=1, share=1.0).weights.flat()
    quarter = lm_scoring.fit(learned, counted, rounds=1, share=0.25).weights.flat()
    assert np.allclose(default, whole, atol=1e-5) and not np.allclose(default, quarter, atol=1e-3)


def test_training_carries_state_through_long_documents(words):
    counts = np.arange(9, 0, -1)
    hashes = np.arange(1, 10).astype(np.uint64)
    model = lm_scoring.Model(45, 9, hashes, counts, 64, gru.initial(64, 8, np.ones(64)))
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words(1100)), " ".join(words(7))])], ["text"])
    (group,) = lm_scoring._groups(iter([batch]), lm_scoring.Lookup(hashes), model)
    tokens, bounds = lm_scoring._flat(group)
    assert list(np.diff(bounds)) == [1101, 8]
    want = gru.train(model.weights, gru.Lanes.of(tokens, bounds, 4), model.end).flat()
    made = list(lm_scoring._fit(SimpleNamespace(value=model), 4, iter([batch])))
    assert {b.column("weight")[0].as_py() for b in made} == {1109.0}
    (got,) = lm_scoring._averaged(iter(made + made))
    assert np.allclose(got.column("values")[0].values.to_numpy(), want, atol=1e-6)


def test_lanes_that_end_within_a_window(words):
    rng = np.random.default_rng(3)
    sizes = np.array([70, 3, 9, 40, 41, 1, 17])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(0, 64, bounds[-1]).astype(np.int16)
    w = gru.initial(64, 6, np.ones(64))
    lanes = gru.Lanes.of(tokens, bounds, 4)
    seen = np.concatenate(
        [at.ravel() if real is None else at[real] for at, real in lanes.windows(1, 7)]
    )
    assert sorted(seen) == list(range(bounds[-1]))
    assert len(list(lanes.windows(1, 7))) == -(-lanes.lengths[0] // 7)
    one_by_one = [
        gru.score(w, gru.Lanes.of(tokens[a:b], np.array([0, b - a]), 1), 3)[0]
        for a, b in zip(bounds, bounds[1:], strict=False)
    ]
    assert np.allclose(gru.score(w, lanes, 3, 1, 7), one_by_one, atol=1e-4)


def test_vocabulary_holds_thousands_of_words(table):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(100)]
    learned = table(rows).select(F.col("doc_id").alias("row"), "text")
    model = lm_scoring.fit(learned, lm_scoring.count_words(learned, "text"), rounds=1)
    assert model.known == 3001
