"""Line dedup, unit dedup and token files against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, token_files, unit_dedup
from tidemark.llm.line_suffixes import kept_text, repeated_lines, suffix_depths
from tidemark.llm.unit_dedup import deduplicated, repeated_passages, repeated_units


def plain_lines(rows, min_lines=2, min_words=8):
    """Later copies of runs, by looking at every run of every length."""
    seqs = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = [x.strip(" \t\x0b\x0c\r") for x in (text or "").split("\n")]
        seqs.append((doc, [(at, x) for at, x in enumerate(lines) if x]))
    drops = [set() for _ in seqs]
    shared = [0] * len(seqs)
    size = 1
    while any(len(s) >= size for _, s in seqs):
        seen = set()
        for k, (_, s) in enumerate(seqs):
            for i in range(len(s) - size + 1):
                run = tuple(x for _, x in s[i : i + size])
                if run in seen:
                    if size & (size - 1) == 0:
                        shared[k] = max(shared[k], size)
                    if size >= min_lines or (size == 1 and len(run[0].split()) >= min_words):
                        drops[k] |= {at for at, _ in s[i : i + size]}
                seen.add(run)
        size += 1
    return sorted(
        (str(doc), sorted(d), n) for (doc, _), d, n in zip(seqs, drops, shared, strict=True)
    )


def shown(found):
    return sorted((str(r.doc_id), list(r.drops), r.shared_lines) for r in found.collect())


def line_rows(words):
    line = [" ".join(words(9)) for _ in range(6)] + ["a", "b", "c d"]
    run = [line[0], line[6], line[1], line[7], line[2]]
    return [
        (3, "\n".join([line[3], *run, line[8]])),
        (1, "\n".join(["own", *run[:4], "", "  ", run[4], "end"])),
        (2, "a\na\na\na\nx\na\na"),
        (5, "\n".join([line[8], line[6], " " + line[7], "b"])),
        (6, line[4] + "\r\n" + line[5]),
        (7, line[5] + "\n" + line[4]),
        (8, line[4] + "\n" + line[5] + "\t"),
        (9, None),
        (10, ""),
        (None, "\n".join(run)),
        (11, "\n".join([line[0]] * 5)),
        (12, "\n".join(f"{k} only here" for k in range(30))),
        (13, "\n".join(f"{k} only here" for k in range(3, 30))),
    ]


def test_line_runs_equal_plain_version(table, words):
    rows = line_rows(words)
    assert shown(repeated_lines(table(rows))) == plain_lines(rows)
    assert repeated_lines(table(rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        repeated_lines(table(rows), min_lines=3)


def test_repeated_rows_keep_one(table, words):
    text = "\n".join(" ".join(words(9)) for _ in range(3))
    got = repeated_lines(table([(4, text), (4, text), (4, text)])).collect()
    assert sorted(len(r.drops) for r in got) == [0, 3, 3]


def test_kept_text(spark):
    df = spark.createDataFrame([("a\nb\nc", [1]), ("a\nb", []), ("a", [0])], "t string, d array<int>")
    assert [r[0] for r in df.select(kept_text(F.col("t"), F.col("d"))).collect()] == ["a\nc", "a\nb", ""]


def test_suffix_order_is_that_of_the_sequences(spark):
    """Suffixes that share the first lines are one interval, at every depth."""
    seq = [4, 9, 4, 9, 4, 7, 4, 9, 4, 9, 1]
    rows = [(1, 1, i, len(seq) - i, x << 40) for i, x in enumerate(seq)]
    depths = suffix_depths(
        spark.createDataFrame(rows, "row long, doc long, pos int, left int, id long")
    )
    for depth in depths:
        seen, later = set(), set()
        for i in range(len(seq) - depth.lines + 1):
            run = tuple(seq[i : i + depth.lines])
            later |= {i} if run in seen else set()
            seen.add(run)
        assert {r.pos for r in depth.later.collect()} == later
    assert [d.lines for d in depths] == [1, 2, 4]


def test_units_equal_plain_version(table, words):
    one, two = " ".join(words(12)), " ".join(words(11))
    rows = [
        (4, f"{one}\nshort line\n{two}"),
        (2, f"x\n{one.upper()}  \n{two}\n{two}"),
        (7, f"{one}\n\n{two}\n \n{one}"),
        (8, "short line"),
        (9, None),
        (10, ""),
        (None, one),
    ]
    for by in ("line", "paragraph"):
        seen, want = {}, set()
        for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            for a, b in unit_dedup.units(text or "", by):
                plain = unit_dedup.normalised((text or "")[a:b])
                if len(plain.split()) >= 10:
                    if plain in seen:
                        want.add((doc, a, b, *seen[plain]))
                    seen.setdefault(plain, (doc, a))
        got = repeated_units(table(rows), by=by).collect()
        assert {(r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in got} == want
        assert len(got) == len(want)
    kept = {r.doc_id: r for r in deduplicated(table(rows[:3])).collect()}
    assert kept[2].text == f"x\n{one.upper()}  \n{two}\n" and kept[4].text == "\nshort line\n"
    assert kept[7].text == "\n\n\n \n" and len(kept[7].removed) == 3
    assert repeated_units(table(rows).where("false")).count() == 0


def plain_passages(rows, size=50):
    """Words of later and of shared passages, by looking at every passage of every text."""
    texts = [
        (doc, [unit_dedup.normalised(w) for w in (text or "").split()])
        for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0]))
    ]
    places = {}
    for k, (_, seq) in enumerate(texts):
        for i in range(len(seq) - size + 1):
            places.setdefault(tuple(seq[i : i + size]), []).append((k, i))
    later, shared = ([set() for _ in texts] for _ in range(2))
    for found in places.values():
        for k, i in found:
            if any(x < k or (x == k and at + size <= i) for x, at in found):
                later[k] |= set(range(i, i + size))
            if any(x != k for x, _ in found):
                shared[k] |= set(range(i, i + size))
    return {doc: (later[k], shared[k]) for k, (doc, _) in enumerate(texts)}


def passage_rows(words):
    """Texts that share passages of 49 to 120 words amid others, cut into other lines."""
    one, two, long = words(50), words(49), words(400)
    own = lambda n: words(n)
    near = [w if k % 70 else "changed" for k, w in enumerate(long)]
    return [
        (5, " ".join([*own(30), *one, *own(9)])),
        (3, "\n".join([*own(7), *[w.upper() for w in one], *own(80)])),
        (8, "  ".join(own(3) + two + own(60))),
        (6, "\n\n".join([" ".join(two), " ".join(own(40))])),
        (1, " ".join(long)),
        (2, "\n".join(" ".join(near[k : k + 4]) for k in range(0, 400, 4))),
        (9, " ".join(long[100:160] + long[20:75] + one + one)),
        (10, " ".join(long)),
        (11, "La " * 130),
        (12, "la " * 70 + " ".join(one[:30])),
        (13, " ".join(one[1:] + own(1) + one[:49])),
        (14, None),
        (15, ""),
        (16, " ".join(own(55))),
        (None, " ".join(own(5) + long[300:] + own(5))),
    ]


def test_passages_equal_plain_version(table, words):
    rows = passage_rows(words)
    want = plain_passages(rows)
    found = repeated_passages(table(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        got = [{at for s in spans for at in range(s.start, s.end)} for spans in (r.removed, r.shared)]
        assert got == list(want[r.doc_id]), r.doc_id
    assert all(want[k][0] for k in (5, 2, 9, 10, 12, None)) and not any(want[k][0] for k in (3, 6, 8, 13))
    assert repeated_passages(table(rows).where("false")).count() == 0


def test_passages_of_random_texts_equal_plain_version(table, words):
    """Few kinds of words and many pieces, so that passages meet in every way."""
    rng = np.random.default_rng(3)
    pieces = [words(int(n)) for n in rng.integers(20, 90, 12)] + [["a"] * 60, ["a", "b"] * 40]
    rows = [
        (k, " ".join(w for p in rng.integers(0, len(pieces), rng.integers(1, 7)) for w in pieces[p]))
        for k in range(60)
    ]
    want = plain_passages(rows)
    for r in repeated_passages(table(rows)).collect():
        got = [{at for s in spans for at in range(s.start, s.end)} for spans in (r.removed, r.shared)]
        assert got == list(want[r.doc_id]), r.doc_id


def test_of_rows_equal_in_id_and_text_one_stays(table, words):
    text = " ".join(words(64))
    found = repeated_passages(table([(4, text), (4, text), (4, "short"), (4, "short")])).collect()
    spans = sorted([(s.start, s.end) for s in r.removed] for r in found)
    assert spans == [[], [], [], [(0, 64)]]


def test_op3_has_a_row_for_every_document(spark):
    folder = "/root/testdata/sf0.001"
    found = catalog.op3_unit_dedup(spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = plain_passages([(r.doc_id, r.text) for r in texts])
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_removed, r.n_shared) for r in found} == {
        k: tuple(len(x) for x in v) for k, v in want.items()
    }


def test_token_counts_over_any_blocks(spark, table, words, folder):
    rows = [(k, " ".join(words(k * 7))) for k in range(9)] + [(20, None), (21, ""), (None, "été <|endoftext|>")]
    encoding = token_files.encoder(token_files.RANKS)
    want = sorted((str(i), len(encoding.encode_ordinary(t or ""))) for i, t in rows + rows[:2])
    for size in (2, 10, 64, 1 << 19):
        got = token_files.document_tokens(table(rows + rows[:2]), block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_files.document_tokens(table(rows).where("false")).count() == 0


def test_flat_files_of_others(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = {}
    for name in ("a", "b", "c"):
        lengths = rng.integers(0, 40, 30)
        tokens = np.concatenate([np.append(rng.integers(0, 500, n), 999) for n in lengths])
        if name == "b":
            tokens = np.append(tokens, [5, 6, 7])
            lengths = np.append(lengths, 3)
        tokens.astype("<u2").tofile(tmp_path / f"{name}.bin")
        want[name] = lengths.tolist()
    blocks = token_files.read_files(spark, str(tmp_path), block_bytes=34)
    got = {}
    for r in token_files.scan(blocks, end=999).orderBy("file", "nth").collect():
        got.setdefault(r.file[-5], []).append(r.n_tokens)
    assert got == want
