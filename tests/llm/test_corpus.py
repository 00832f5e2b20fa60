"""Operators that compare rows with each other, against brute force."""

import itertools
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shoalmark.llm import LLM_ORACLES, LLM_QUERIES, decontamination, embeddings, jaccard_join, line_dedup, packing
from shoalmark.llm.common import components
from shoalmark.llm.text import shingles
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_against_sql(spark, con, name):
    df = LLM_QUERIES[name](spark, SF)
    cur = con.execute(LLM_ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def _closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _closure({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[ \t-\r]+", low) if w]


def _set(text, width):
    w = _words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_shingles():
    texts = [None, "", " \t\r\n", "One", "one TWO", "a b c d e a b c d", "É é A\x0bb\x0cc d\x1ce f", "x" * 9999 + " y z q", "a b c d", "A B C D", "日本 語 a b c"]
    texts += texts[::-1]
    for width in (1, 4, 5):
        sizes = [len(_set(t, width)) for t in texts]
        got = list(shingles(pa.array(texts), width, block=16))
        assert [len(g) for g in got] == sizes
        for (i, a), (j, b) in itertools.combinations(enumerate(got), 2):
            assert len(np.intersect1d(a, b)) == len(_set(texts[i], width) & _set(texts[j], width))
        sliced = list(shingles(pa.array(texts).slice(3, 6), width))
        assert all((x == y).all() for x, y in zip(sliced, got[3:9]))


def _corpus(rng, n_bases, vocabulary=4000):
    docs = [None, "", "  ", "single", "Single", "two words", "two words ", "a b c d", "a b c d e"]
    passage = " ".join(f"p{rng.randrange(60)}" for _ in range(25))
    for b in range(n_bases):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 120))]
        if b % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
            docs.append(" ".join(copy))
    # a chain and a group of near copies of one another
    chain = [f"c{i}" for i in range(60)]
    for i in range(30):
        docs.append(" ".join(chain))
        chain = chain[1:] + [f"d{i}"]
    base = [f"g{i}" for i in range(80)]
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(80)] = f"h{rng.randrange(10**6)}"
        docs.append(" ".join(copy))
    return docs


def _jaccard_truth(rows, width, num, den):
    sets = [_set(t, width) for _, t in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
            links.append((rows[i][0], rows[j][0]))
    return sets, _closure([r[0] for r in rows], links)


@pytest.mark.parametrize("width,num,den,sketch", [(4, 85, 100, 1 << 20), (5, 8, 10, 1024)])
def test_jaccard_join(spark, width, num, den, sketch):
    rng = random.Random(width)
    docs = _corpus(rng, 110)
    ids = rng.sample(range(10_000), len(docs))
    rows = list(zip(ids, docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, width, num, den, sketch=sketch).collect()}
    sets, comp = _jaccard_truth(rows, width, num, den)
    assert got == {i: (len(s), comp[i]) for (i, _), s in zip(rows, sets)}


def test_jaccard_open_groups(spark):
    """Buckets whose members lie in several components go through the groups, small ones here."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(12)]
    docs = [" ".join(shared + [f"t{k % 12}" for k in range(i % 12, i % 12 + 3)]) for i in range(90)]
    docs += [" ".join(rng.sample(shared, 12)) for _ in range(40)] + [" ".join(shared[: rng.randint(6, 12)]) for _ in range(40)]
    rows = list(enumerate(docs))
    old = jaccard_join._group_candidates.__defaults__
    jaccard_join._group_candidates.__defaults__ = (3, 2)
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 8, 10, sketch=1024).collect()}
    finally:
        jaccard_join._group_candidates.__defaults__ = old
    assert got == _jaccard_truth(rows, 2, 8, 10)[1]


def test_jaccard_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text, "x"), (5, text, "x"), (3, text.upper(), "y"), (None, text, "z"), (None, None, None), (7, "q r s t u", "n"), (7, "v w x y z", "n"), (8, "v w x y z", "n"), (9, "q r s t u", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85, 100).collect()), key=repr)
    assert got == sorted([(5, 5, 3), (5, 5, 3), (3, 5, 3), (None, 5, 3), (None, 0, None), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 2, 7)], key=repr)
    kept = sorted((r.doc_id for r in jaccard_join.one_per_group(df).collect()), key=repr)
    assert kept == sorted([3, 7, 7, None], key=repr)  # unrelated texts of one id stay, a copy without id goes
    assert jaccard_join.jaccard_components(df.limit(0), 4, 85, 100).collect() == []


def test_jaccard_texts_of_one_id(spark):
    """Every text of an id is compared, whatever its sizes and whoever has copies of the id's other texts."""
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    a, b, c = words("a", 40), words("b", 40), words("c", 80)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(a)), (7, " ".join(b[:-1] + ["x"]))]
    # 10 is the first and 19 the last of its bucket with one size each; the longer text of 10 is near 13 alone
    rows += [(10, " ".join(c[:20])), (10, " ".join(c)), (13, " ".join(c[:-1] + ["y"])), (19, " ".join(c[:20] + ["z"]))]
    rng = random.Random(4)
    texts = [t for t in _corpus(rng, 60, 300) if _set(t, 4)]
    rows += [(100 + rng.randrange(400), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85, 100, sketch=1024).collect()}
    comp = _jaccard_truth(rows, 4, 85, 100)[1]
    assert comp[7] == 2 and comp[13] == 10
    assert got == {(i, comp[i]) for i, _ in rows}


def _vectors(rng):
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((base + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25])) * rng.uniform(0.1, 9))
    hot = rng.standard_normal(16)
    rows += [hot + rng.standard_normal(16) * 0.12 for _ in range(60)] + [hot] * 30
    return [(i, [float(x) for x in v], int(i % 3) if i % 11 else None) for i, v in enumerate(rows)]


@pytest.mark.parametrize("tile", [16, 1024])
def test_vector_components(spark, tile):
    rows = _vectors(np.random.default_rng(4))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] + [1.0] * 15, 1),
             (n + 5, [float("inf")] + [1.0] * 15, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (None, rows[1][1], 1), (n + 8, [1e-200] * 16, 1), (n + 9, [1e200] * 16, 1)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = {r[0]: embeddings.unit(np.array([r[1]]))[0] for r in good}
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2)
             if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= 0.93]
    comp = _closure([r[0] for r in rows if r[0] is not None], links)
    count = {i: sum(i in e for e in links) for i in comp}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.vector_components(df, 0.93, tile).collect()}
    want = {i: (count[i], c, i == c) for i, c in comp.items()} | {None: (0, None, True)}
    assert got == want and max(count.values()) > 20
    assert embeddings.vector_components(df.limit(0), 0.93).collect() == []


def test_best_fit_against_a_linear_scan():
    rng = random.Random(2)
    for _ in range(30):
        items = [(rng.randint(0, 50), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(rng.randint(0, 120))]
        bins, placed = [], [None] * len(items)
        for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
            n, s, c = items[i]
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and (s is None or s not in b[1]) and (c is None or c not in b[2])]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append([50, set(), set()])
            bins[k][0] -= n
            bins[k][1].add(s)
            bins[k][2].add(c)
            placed[i] = k
        assert packing.best_fit(items, 50) == (placed, len(bins))


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 40, 100, 101, 250]))), rng.choice(["hot", "hot", "a", None])) for i in range(400)]
    rows += [(None, None, None), (7, rows[7][1], rows[7][2]), (401, "", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, bin int")
    out = packing.pack_documents(df, 100, 64).collect()
    pieces = {}
    for r in out:
        pieces.setdefault((r.shard, r.bin), []).append(r)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.length for r in out) == total and {r.doc_id for r in out} == {r[0] for r in rows}
    source = {r[0]: r[2] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for own in pieces.values():
        assert sum(r.length for r in own) <= 100
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        tags = [source[r.doc_id] for r in own if source[r.doc_id]]
        assert len(tags) == len(set(tags))
        copies = [text[r.doc_id] for r in own if text[r.doc_id] is not None]
        assert len(copies) == len(set(copies))
    assert len({r.shard for r in out}) == -(-len(rows) // 64)
    assert packing.pack_documents(df.limit(0)).collect() == []


def _near(item, text):
    """Least edit distance between the item and any part of the text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def test_myers_against_dynamic_programming():
    rng = random.Random(7)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + item[rng.randint(0, 3):][: rng.randint(1, 90)]
        assert decontamination.myers(decontamination.masks(item), len(item), text)[0] == _near(item, text)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(12)]
    items += [(12, None), (None, "null id " * 5), (13, "too short"), (14, ""), (0, items[0][1])]
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            passage = list(items[rng.randrange(12)][1])
            for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 20])):
                k = rng.randrange(len(passage))
                passage[k] = rng.choice(["", "zz", "q", passage[k].upper(), " \n"])
            words.insert(rng.randrange(len(words) + 1), "".join(passage))
        docs.append((i, " ".join(words)))
    docs += [(None, items[3][1]), (200, None), (201, ""), (5, docs[5][1]), (202, items[1][1].upper().replace(" ", "\n\n  ")), (203, "İ" * 30 + " " + items[2][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = sorted({(i, decontamination.normal(t)) for i, t in items if i is not None and t and len(decontamination.normal(t)) >= 20})
    want = {}
    for n, (i, t) in enumerate(docs):
        for k, item in usable:
            d = _near(item, decontamination.normal(t or ""))
            if d <= int(len(item) * decontamination.RATE):
                want[(i, k)] = d
    for block in (decontamination.BLOCK_CHARS, 500):
        out = decontamination.find_leaks(df, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in out} == want
    assert len(out) == len(want) + ((5, usable[0][0]) in want and 1 or sum(k[0] == 5 for k in want))
    text = dict(docs)
    for r in out:
        if r.doc_id is not None:
            part = decontamination.normal(text[r.doc_id][r.start:r.end])
            assert _near(part, dict(usable)[r.item_id]) <= r.distance or r.distance == 0 and part == dict(usable)[r.item_id]
    clean = decontamination.decontaminate(df, bench, block_chars=500)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if not any(k[0] == i for k in want)), key=repr)
    assert decontamination.find_leaks(df.limit(0), bench).collect() == []
    assert decontamination.find_leaks(df, bench.limit(0)).collect() == []


def _dedup(rows):
    keyed = sorted({(i is None, i if i is not None else 0, t) for i, t in rows}, key=lambda r: r[:2])
    first, out = {}, {}
    for no_id, i, t in keyed:
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if not any(w):
                continue
            if w in first:
                gone |= {k, k + 1, k + 2}
            else:
                first[w] = 1
        out[(None if no_id else i, t)] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)] + ["", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "a\nb\nc"), (503, "a\nb\nc"), (504, "a\nb\nc"), (505, "r\nr\nr\nr\nr"), (None, "a\nb\nc"), (506, "\n".join(f"l{i}" for i in range(20000)))]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_lines int").repartition(5)
    got = line_dedup.dedup_lines(df).collect()
    want = _dedup(rows)
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=repr) == sorted(((i, *want[(i, t)]) for i, t in rows), key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = out.collect()
        if name != "packs":
            assert out.columns == names
            ids = {r.doc_id for r in after}
            assert len(ids) == len(after) and ids <= set(before)
        gone = [r for i, r in before.items() if name != "packs" and i not in ids]
        if name == "quality":
            label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum(label.get(r.doc_id) == 1 for r in gone) <= 2 and gone
            assert sum(label.get(i) == 0 for i in ids) <= 2
        elif name == "lines":
            want = _dedup([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: r.text for r in after} == {i: w[2] for (i, _), w in want.items() if not w[1] or w[2].strip()}
        elif name == "groups":
            comp = _jaccard_truth([(i, r.text) for i, r in before.items()], 5, 8, 10)[1]
            assert ids == set(comp.values())
        elif name == "leaks":
            items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            exact = {i for i, r in before.items() if any(t in decontamination.normal(r.text) for t in items)}
            assert exact <= {r.doc_id for r in gone} and len(gone) <= len(exact) + 2
        else:
            assert {r.doc_id for r in after} == set(before)
            assert sum(r.length for r in after) == sum(len(r.text.split()) for r in before.values())
        docs = out


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
