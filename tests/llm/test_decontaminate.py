"""Benchmark decontamination against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from neurotab.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, window=10):
    """[(n_words, hit words, spans, items)] of the texts ``docs``."""
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else []:
            wins.setdefault(tuple(w[s:s + n]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w = words(text)
        found = [(s, s + n, wins[tuple(w[s:s + n])]) for n in {len(k) for k in wins} for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in wins]
        hit = {k for s, e, _ in found for k in range(s, e)}
        out.append((len(w), len(hit), sorted({(s, e) for s, e, _ in found}), sorted(set().union(*[i for *_, i in found]))))
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_decontamination"](spark, SMALL).collect()}
    expected = slow([d["text"] for d in docs], items)
    assert len(got) == len(docs) and any(e[1] for e in expected)
    for d, (n, hit, _, named) in zip(docs, expected):
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(named), hit > 0)


A = [f"w{k}" for k in range(60)]
ITEMS = [(1, " ".join(A[:25])), (10, " ".join(A[10:40])), (2, "Hi THERE"), (3, "x"), (4, None), (5, " -- ,, "), (None, " ".join(A[45:55])),
         (1, " ".join(A[:12])), (7, "Été à Ä ß 你 好 x1 y2 z3"), (8, "a b c d e f g h i j"), (9, "a b c d e f g h i j")]
DOCS = [None, "", "   ", "--", "hi", "Hi, there!", "x X x", " ".join(A), "|".join(A[3:13]).upper(), " ".join(A[3:12]), " ".join(A[9:19] + A[8:18]),
        " ".join(A[40:60] * 30), "été à Ä ß 你 好 X1 Y2 z3", "ÉTÉ à ä ß 你 好 x1 y2 z3", "a b c d e f g h i j " * 400, "a b c d e f g h i",
        "pre " * 2000 + " ".join(A[20:31]) + " post" * 2000, " ".join(A[20:31]), "hi there", "Hi\nTHERE\tx"]
COLUMNS = "n_hit string, text string, f string, window int, doc_id long"


@pytest.mark.parametrize("size", [1, 3, 5])
def test_cases(spark, monkeypatch, size):
    rows = [(str(k), t, "z", k, k if k % 5 else None) for k, t in enumerate(DOCS)]
    docs = spark.createDataFrame(rows + rows[6:8], COLUMNS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if size == 3:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    got = decontaminate.contamination(docs, items, shingle=size, bits=1 << 10).collect()
    assert decontaminate.contamination(docs, items).columns == ["f", "window", "doc_id", "n_words", "n_hit", "spans", "items"]
    expected = slow(DOCS, ITEMS)
    assert sorted((r["window"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in got) == sorted(
        [(k, *e) for k, e in enumerate(expected)] + [(k, *expected[k]) for k in (6, 7)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    for none in (items.limit(0), items.filter("item_id in (4, 5)")):
        assert [tuple(r) for r in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0, [], [])]


def test_partial_containment(spark):
    """Half of the shingles at their places: one changed word in the middle."""
    item = A[:10]
    near = [*A[:8], "changed", A[9]]
    far = [*A[:4], "changed", *A[5:10]]
    docs = spark.createDataFrame([(1, " ".join(["q"] * 3 + near)), (2, " ".join(far)), (3, " ".join(A[:8]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], [tuple(s) for s in r["spans"]]) for r in decontaminate.contamination(docs, items, share=0.5).collect()}
    assert got == {1: (10, [(3, 13)]), 2: (0, []), 3: (0, [])}
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, items).collect())


def test_native_plan(spark):
    out = decontaminate.contamination(spark.createDataFrame([(1, " ".join(A))], "doc_id long, text string"),
                                      spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan.split("== Optimized")[1].replace("createDataFrame", ""))
    assert out.agg(F.max("n_hit")).first()[0] == 50
