"""Registered queries against plain Python on whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from neurotab.llm import queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


def words(text):
    return WORD.findall(text or "")


def test_quality_base(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_quality_rules"](spark, SMALL).collect()}
    assert len(got) == len(documents)
    for d in documents:
        w, r = words(d["text"]), got[d["doc_id"]]
        lines = [x for x in d["text"].split("\n") if words(x)]
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i:i + 8])].append(i)
        hit = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d["text"])), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) == len(good)
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad)


def test_substrings(spark, documents):
    first = {}
    for d in documents:
        w = words(d["text"])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_substring_dedup"](spark, SMALL).collect()}
    removed = 0
    for d in documents:
        w = words(d["text"])
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d["doc_id"] for k in range(i, i + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    assert removed


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_language_model(spark, documents):
    texts = {d["doc_id"]: [*words(lower(d["text"])), None] for d in documents}
    learned = [t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(x for t in learned for x in t)
    pairs = Counter(p for t in learned for p in zip(["<s>", *t], t))
    n, v = sum(count.values()), len(count)
    after = Counter(b for _, b in pairs)
    follows, uses = defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        follows[a][min(c, 3)] += 1
        uses[a] += c

    def discount(cs):
        k = [sum(x == i for x in cs) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        return [0, 1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2]]

    dp, dw = discount(list(pairs.values())), discount(list(after.values()))
    free = sum(dw[min(c, 3)] for c in after.values())

    def low(b):
        return max(after[b] - dw[min(after[b], 3)], 0) / len(pairs) + free / len(pairs) / (v + 1)

    def p(a, b):
        if not uses[a]:
            return low(b)
        c = pairs[a, b]
        return (max(c - dp[min(c, 3)], 0) + sum(dp[k] * follows[a][k] for k in (1, 2, 3)) * low(b)) / uses[a]

    got = {r["doc_id"]: r for r in queries.QUERIES["op7_lm_scoring"](spark, SMALL).collect()}
    for k, t in texts.items():
        r = got[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t)))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # the probabilities of all words and one unknown word add up to one
    for a in ["<s>", learned[0][0], learned[1][3]]:
        assert sum(p(a, b) for b in [*count, "unknown word"]) == pytest.approx(1)


def test_language_labels(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_tokens_equal_the_library(spark, documents):
    import sentencepiece

    from neurotab.llm.sentencepiece import MODEL_FILE

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    for r in queries.QUERIES["op10_sentencepiece"](spark, SMALL).collect():
        text = documents[r["doc_id"]]["text"]
        assert r["ids"] == model.encode(text) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_top_k(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    m = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 64).astype(int)
    got = defaultdict(list)
    for r in queries.QUERIES["op2_topk_search"](spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = [r["vec_id"] for r in rows]
    assert set(got) == {i for i in ids if i % 20 == 0}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            best = sorted((-int(s), j) for s, j in zip(m @ m[k], ids) if j != i)[:20]
            assert got[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_substring_cases(spark):
    from neurotab.llm import substring

    a = [f"a{i}" for i in range(40)]
    lists = [None, "", "  \n\t ", " ".join(a), " ".join(a[5:30]), " ".join(a[:13]), " ".join(a[:12]), " ".join(["x"] * 60), " ".join(["x"] * 13),
             " ".join(a[20:] + a[:20]), "Été " * 15, "\n".join(a)]
    rows = [(k, t, "src", 7) for k, t in enumerate(lists)] + [(3, lists[3], "again", 7), (None, lists[3], "no id", 7), (100, " ".join(a), "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_chars int")
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)

    def slow(i, t):
        w = words(t)
        gone = {k for s in range(len(w) - 12) if i is not None and first[tuple(w[s:s + 13])] < i for k in range(s, s + 13)}
        return len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)

    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"] or "") for r in substring.remove_repeats(docs).collect())
    assert got == sorted((i is None, i, *slow(i, t)) for i, t, *_ in rows)
    kept = substring.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_longer_prefixes(monkeypatch):
    import numpy as np

    from neurotab.llm import substring

    a = [f"a{i}" for i in range(40)]
    runs = [" ".join(a[k:k + 20]).encode() for k in range(15)]
    lens, low = np.full(15, 20), np.arange(15)[::-1]
    whole = substring.subtrees(runs, lens, low)
    monkeypatch.setattr(substring, "SUBTREE_WORDS", 50)
    assert (whole == substring.subtrees(runs, lens, low)).all()
