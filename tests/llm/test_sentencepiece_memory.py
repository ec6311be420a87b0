"""Collecting units in bounded memory gives the same tokens."""

import pyarrow as pa

from neurotab.llm import sentencepiece as sp


def test_small_limits_give_the_same_tokens(spark, monkeypatch):
    texts = ["one two, three  four\tfive", None, "", "tail words, and more words; more", "\u00fcber \u6587\u5b57 " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lambda: sorted((r["doc_id"], r["ids"], r["n_tokens"], r["round_trip"]) for r in sp.tokenize(docs).collect())
    want = rows()
    for name, limit in (("SEEN_UNITS", 3), ("CUT_UNITS", 2), ("BATCH_CHARS", 5)):
        monkeypatch.setattr(sp, name, limit)
    assert rows() == want and all(r[3] for r in want)


def test_units_are_cut_some_at_a_time():
    """What cutting holds beside the names does not grow with their number."""
    import tracemalloc

    pieces, peaks = sp.pieces_of(sp.MODEL_FILE), []
    for n in (50_000, 200_000):
        seen = {f"word{k}" for k in range(n)}
        tracemalloc.start()
        found = 0
        for batch in sp.cut_units(pieces, seen):
            assert isinstance(batch, pa.RecordBatch)
            found += batch.num_rows
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found > 0
    assert peaks[1] < 1.3 * peaks[0] < 60e6
