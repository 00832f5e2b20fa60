"""Columns with the operators' own names, ids of other types, repeated ids, parts in the environment-file form."""

import pytest

import corpus_pipeline
from shoalmark.llm import decontamination, jaccard_join, line_dedup, secret_scans

SF = "/root/testdata/sf0.001"


def test_line_dedup_keeps_clashing_columns(spark):
    lines = "\n".join(f"line number {i}" for i in range(6))
    rows = [(1, lines, "a", "b", "c", 5), (2, "first\n" + lines, "d", "e", "f", 6), (2, "other\ntext\nhere", "g", "h", "i", 7), (None, lines, "j", "k", "l", 8), (3, None, "m", "n", "o", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash string, _lines string, n_removed int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r._id, r._hash, r._lines, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()))
    assert got == [(False, 1, "a", "b", "c", lines, 6, 0), (False, 2, "d", "e", "f", "first", 7, 6), (False, 2, "g", "h", "i", "other\ntext\nhere", 3, 0),
                   (False, 3, "m", "n", "o", None, 1, 0), (True, 0, "j", "k", "l", "", 6, 6)]


def test_decontamination_of_text_ids(spark):
    item = "a question about nothing in particular at all"
    bench = spark.createDataFrame([("q-1", item), ("q-2", None), (None, item), ("q-3", "short")], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "x " + item.upper() + " y", [1]), ("d2", "clean", [2]), (None, None, None), ("d4", "z" * 200_000 + " " + item, None)], "doc_id string, text string, leaks array<int>")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.distance) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == [("d1", "q-1", 2, 2 + len(item), 0), ("d4", "q-1", 200_001, 200_001 + len(item), 0)]


def test_jaccard_of_text_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("b", base), ("a", base + " end"), ("c", "something else entirely here now"), (None, base), ("d", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got["a"][1] == got["b"][1] == "a" and got["c"][1] == "c" and got["d"] == (0, "d") and len(got) == 5


def test_groups_of_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "x"), (1, "a wholly different text of the same id", "y"), (1, base, "z"), (None, base + " end", "n"), (None, "no id and alone in its group", "m"), (2, base + " tail", "t"), (3, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _no string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in jaccard_join.one_per_group(docs).collect()))
    assert got == [(0, "no id and alone in its group"), (1, "a wholly different text of the same id"), (1, base), (3, "")]


def test_secret_scans_environment_file(spark):
    text = "DB_USER=app\nDB_HOST=db.example.com\nDB_PASS=x9k2z\n"
    run = "key " + "x" * 50 + "B" * 50 + "7 user=ann"
    docs = spark.createDataFrame([(1, text), (2, "DB_PASS=x9k2z alone"), (3, run)], "doc_id long, text string")
    got = {r.doc_id: r.linked for r in secret_scans.scan_secrets(docs).collect()}
    assert got[1] == "identifier:3:11,endpoint:15:34,secret:38:48" and got[2] == ""
    assert got[3] == "secret:4:105,identifier:106:114"


CLASHES = {"score": "string", "predicted": "string", "leaks": "string", "n_lines": "string", "n_removed": "string", "_id": "string", "_hash": "string", "_row": "string"}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, name, stage):
    lines = "\n".join(f"a line of plain prose with the number {i} in it" for i in range(40))
    rows = [(i, None if i == 3 else lines if i % 4 == 0 else lines.replace("plain", f"p{i}"), "en", "s", i) for i in range(12)] + [(2, "again", None, None, None), (None, lines, "en", "s", 1), (50, "x" * 100_000, "en", "s", 1)]
    extra = list(CLASHES)
    docs = spark.createDataFrame([(*r, *[f"{c}-{k}" for c in extra]) for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in CLASHES.items()))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        k = r.score.split("-")[1]
        assert all(r[c] == f"{c}-{k}" for c in extra) and r.doc_id == rows[int(k)][0]
    assert stage(spark, docs.limit(0), SF).collect() == []
