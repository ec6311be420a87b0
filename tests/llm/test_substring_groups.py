"""What stands together in the grouped steps of the passage removal."""

from neurotab.llm import substring


def test_rows_without_id_or_with_one_id_are_spread(spark, monkeypatch):
    """No chunk may hold all rows without an id, or all rows of one id."""
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(None, f"{a} n{k}") for k in range(200)] + [(7, f"{a} s{k}") for k in range(200)] + [(8 + k, f"{a} t{k}") for k in range(5)] + [(99, "short"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2000)
    rows += [(60, f"{a} equal rows")] * 640
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    seen = []
    group_by = type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *c: (seen.append(self) if c == ("chunk",) and "bucket" not in self.columns else None) or group_by(self, *c))
    out = substring.remove_repeats(docs).collect()
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["text"]): r for r in out}
    assert all(r == got[r["doc_id"], r["text"]] for r in out)
    most = group_by(seen[0], "chunk").count().agg({"count": "max"}).first()[0]
    assert most < 200 and seen[0].where("c0 is null or length(c1) < 25").count() == 0
    for (i, text), r in got.items():
        assert r["n_removed"] == (30 if i is not None and 7 < i < 70 else 0), i
        assert r["n_words"] == len((text or "").split()) and (r["kept_text"] is None) == (text is None)


def test_windows_of_a_common_phrase_are_spread(spark, monkeypatch):
    """A phrase with other words around it in each document is no bucket of its
    own, and the results stay those of plain Python."""
    phrase = "the common phrase of all documents".split()
    rows = []
    for k in range(300):
        w = [f"a{k}x{i}" for i in range(9)] + phrase + [f"b{k}x{i}" for i in range(9)]
        rows.append((k, " ".join(w if k % 10 else w[:5] + [f"c{i}" for i in range(4)] + phrase + [f"d{i}" for i in range(9)])))
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring, "BUCKET_WORDS", 1000)
    most = {}
    for limit in (300, 10**9):
        monkeypatch.setattr(substring, "SUBTREE_WORDS", limit)
        texts = [t.encode() for _, t in rows]
        told = list(substring.tell_prefixes(texts, 1))
        shared = substring.Shared([(0, substring.branching([body for _, body in told])[0])], 1)
        assert 0 < len(shared.keys) < 200 and shared.large.any() == (limit == 300)
        chunk = substring.Chunk([i for i, _ in rows], texts, 50, shared)
        most[limit] = max(sum(chunk.words[r] for r in runs.tolist()) for _, runs in chunk.by_bucket())
        assert {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(docs).collect()} == want
    assert most[300] < most[10**9] / 2
