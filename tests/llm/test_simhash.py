import itertools

import numpy as np
import pytest
import xxhash

from neurotab.llm import simhash as sh


def test_golay_indices_meet_within_two_bits():
    tables = sh.golay_tables()
    upper, errors = tables
    leaders = errors[:, 0]  # one word of every coset: codeword shifts move all indices alike
    patterns = [0] + [1 << a for a in range(23)] + [(1 << a) | (1 << b) for a, b in itertools.combinations(range(23), 2)]
    base = sh.golay_indices(leaders, tables)
    for p in patterns:
        other = sh.golay_indices(leaders ^ p, tables)
        meet = (base[:, :, None] == other[:, None, :]) & (base[:, :, None] >= 0)
        assert meet.any(axis=(1, 2)).all()


def slow_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh3 = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh3]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one two", "A b\tC d É é", "x y " * 40000])
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def brute(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowded", [128, 2])
def test_links_against_all_pairs(spark, crowded, monkeypatch):
    from neurotab.llm.components import connected_components

    monkeypatch.setattr(sh, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):  # chains of near fingerprints, and crowds that share segments
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(15):
            fps.add(x)
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    got = connected_components(sh.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    comp = {r["node"]: r["component"] for r in got}
    roots = brute(fps)
    want = {s: min(t for t, q in zip(signed, roots) if q == r) for s, r in zip(signed, roots)}
    assert {s: comp.get(s, s) for s in signed} == want


def test_operator_and_stage(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text.upper(), "b"), (3, text.upper(), "b"), (None, text, None), (9, None, "c"), (8, "", "c"),
            (7, "quite another text of its own", "d"), (None, "no id here at all", "e"), (None, "no id here at all", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in sh.near_duplicates(docs).collect()}
    assert sorted((k[0] is None, k[0], v) for k, v in got.items() if k[0] is not None) == [(False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 8), (False, 9, 8)]
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"] or -1, r["fp"]) for r in kept.collect()]) == [(-1, "e"), (3, "b"), (7, "d"), (8, "c")]
    assert sh.near_duplicates(docs.limit(0)).count() == 0 == sh.drop_near_duplicates(docs.limit(0)).count()
