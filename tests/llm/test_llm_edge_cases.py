"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from neurotab.llm import html_extract, kneser_ney, langid, mixing, quality, sentencepiece, topk_search, warc

LONG = " ".join(f"word{i}" for i in range(30000)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The first text of all, with words.", "a", "x"), (1, "The first text of all, with words.", "a", "x"), (2, None, "a", "y"),
            (3, "", None, "y"), (4, " \t\n ", "b", None), (None, "No id but words here.", "b", "x"), (6, LONG, None, "y"), (7, "123 ½ ... !!", "c", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_pages():
    cases = {
        None: "", "": "", "plain  text": "plain text", "<p>a<p>b &amp; c&nbsp;d": "a\nb & c d",
        "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>Short.</p><section class='comments'><p>me too!</p></section></article>": "T\nShort.",
        "<div id=cookie-notice>We use cookies</div><div class=content><p>" + "One real sentence. " * 9 + "</p><p>End.</p></div><aside>more</aside>":
            ("One real sentence. " * 9).strip() + "\nEnd.",
        "<ul><li><a>x</a></li><li><a>y</a></li></ul><div><p>Body text that is long enough to count.</p></div>": "Body text that is long enough to count.",
        "<article><p>a<!-- c --><b>b</b><script>if (a < b) {}</script> c": "ab c",
        "<article><p>cut off <b>in the mid": "cut off in the mid", "<![if x]><p>odd": "odd",
        "<html><head><title>T</title><body><p>No end of the head here.": "No end of the head here.",
        "<article><header><h1>Title</h1></header><p>One.</p><noscript><p>Enable it</p></noscript><p>Two.</p><form><input><p>mail</p></form></article>": "Title\nOne.\nTwo.",
        "<article><p>See <a href=x>this</a> <span class='ad'>buy</span> now.</p><footer>f</footer></article><div class='sidebar'><p>side</p></div>": "See this now.",
    }
    for html, text in cases.items():
        assert html_extract.extract(html) == text, html
    assert html_extract.extract("<article><p>" + "x " * 500_000 + "</p></article>") == ("x " * 500_000).strip()


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, []), (8, [1.0]),
            (9, [1.0, 0.5]), (9, [1.0, 0.5]), (None, [1.0, 1.0]), (11, [-1.0, -0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 4).collect()
    ok = [(i, [math.floor(64 * x) for x in v] + [0] * (2 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in (0, 20):
        mine = min(v for i, v in ok if i == q)
        want = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)[:4]
        assert [(r["rank"], -r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(n + 1, s, i) for n, (s, i) in enumerate(want)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 4).count() == 0


def test_shards_and_pruning(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    m = np.floor((centres[rng.integers(6, size=900)] + rng.normal(size=(900, 16)) * 0.1) * 64).astype(np.int64)
    m[100:140] = m[100]  # ties
    ids = rng.permutation(900)
    order = topk_search.neighbours_first(m)
    for k in (1, 20, 1000):
        best, found = topk_search.search(m[:30], ids[:30], np.full(30, np.iinfo(np.int64).min), m[order], ids[order], k)
        for q in range(30):
            want = sorted((-int(s), int(j)) for s, j in zip(m @ m[q], ids) if j != ids[q])[:k]
            have = [(-int(s), int(j)) for s, j in zip(best[q], found[q]) if j >= 0]
            assert have == want
    # several shards: the bound of the first one prunes the others, nothing is lost
    monkeypatch.setattr(topk_search, "SHARD", 128)
    monkeypatch.setattr(topk_search, "GROUP", 8)
    df = spark.createDataFrame([(int(i), [float(x) / 64 for x in v]) for i, v in zip(ids, m)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for q in range(900):
        if ids[q] % 20 == 0:
            assert sorted(by[ids[q]]) == sorted((-int(s), int(j)) for s, j in zip(m @ m[q], ids) if j != ids[q])[:20]


def test_archives(spark, tmp_path):
    big = "<p>" + "same page " * 30
    rows = [(5, "http://a/é?x=1", big), (3, "http://b", big), (3, "http://b", big), (None, None, big), (7, None, None), (8, "u", "tiny"), (9, "u", "tiny"), (10, "u\r\nX: y", big + "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(manifest, payloads=True).collect()
    assert len(got) == len(rows)
    want = {(5, "revisit", 3), (3, "response", None), (None, "revisit", 3), (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None)}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == want
    kept = {r["page_id"]: r for r in got if r["record_type"] == "response"}
    assert kept[10]["payload"] == (big + "ü").encode() and kept[10]["url"] == "u\r\nX: y" and kept[7]["payload"] == b""
    assert all(r["payload_bytes"] == len(big) for r in got if r["record_type"] == "revisit")
    # every record can be read alone at its offset
    import zstandard

    for r in manifest.collect():
        raw = open(r["archive"].removeprefix("file://"), "rb").read()
        size = int.from_bytes(raw[4:8], "little")
        frame = raw[r["offset"]:r["offset"] + r["length"]]
        record = zstandard.ZstdDecompressor(dict_data=warc.as_dictionary(raw[8:8 + size])).decompress(frame, max_output_size=1 << 20)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_quality(spark, docs):
    named = docs.withColumn("kept", F.lit("old")).withColumn("n_words", F.lit("old"))
    got = quality.assess(named).collect()
    assert len(got) == 8 and sorted(r["n_words"] for r in got) == [0, 0, 0, 4, 5, 7, 7, 30000]
    assert all(r["base_failed"] == (r["n_words"] < 20) for r in got)
    out = quality.clean(named)
    assert out.columns == named.columns and [(r["doc_id"], r["kept"]) for r in out.collect()] == [(6, "old")]
    assert quality.clean(docs.limit(0)).count() == 0
    lines = ["A good line of text that goes on for a while and ends here." for _ in range(1)] + [" ".join(f"w{i}x{k}" for k in range(9)) + "." for i in range(9)]
    mixed = "\n".join([*lines, "Home | About | Contact | Login", "", "WHAT!! A!! LOUD!! LINE!!", "This work is licensed under CC BY 4.0."])
    row = quality.assess(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first()
    assert row["kept"] and row["clean_text"] == "\n".join([*lines, ""])


def test_mix(spark, docs):
    got = mixing.mix(docs.withColumn("target", F.lit("old"))).collect()
    assert len(got) == 8 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if not r["size"])
    kept = mixing.apply_mix(docs.withColumn("copies", F.lit("old")))
    assert kept.columns == [*docs.columns, "copies"]
    assert kept.filter("doc_id = 6").count() == sum(r["copies"] for r in got if r["doc_id"] == 6)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_hits_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sums, targets = {}, {}
    for r in got:
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"], r["source_size"]
    for s, (t, size) in targets.items():
        assert abs(sums[s] - t) <= 50 and t <= 2 * size + 1e-6
    total = sum(size for _, size in targets.values())
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_pareto_inclusion(spark):
    """Inclusion frequencies come near the probabilities asked for, also unequal ones."""
    p = F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.6)
    rows = spark.range(4000).select("id", p.alias("p"), F.lit(1).cast("long").alias("size"))
    keyed = rows.withColumn("k", mixing.order_key(F.col("p"), mixing.uniform(F.lit("t"), F.col("id")), F.col("id"), F.col("size")))
    taken = keyed.orderBy("k").limit(1600)  # the sum of p
    share = {r["odd"]: r["n"] / 2000 for r in taken.groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n")).collect()}
    assert abs(share[0] - 0.2) < 0.03 and abs(share[1] - 0.6) < 0.03


def test_language(spark, docs):
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert set(model) == {"x", "y"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4, 7))
    assert all(r["lang_pred"] in model and 0 <= r["score"] <= 1 for r in got if r["doc_id"] in (1, 6, None))
    assert langid.train(docs.limit(0)) == {} and langid.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_language_model(spark, docs):
    got = kneser_ney.score(docs, kneser_ney.fit(docs)).collect()
    assert len(got) == 8 and all(r["n_known"] == r["n_tokens"] for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"]} == {1: 8, 2: 1, 3: 1, 4: 1, 6: 30001, 7: 5}
    none = kneser_ney.score(docs, kneser_ney.fit(docs.limit(0))).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in none)


def test_tokens(spark):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)
    texts = [None, "", " ", "  two  spaces ", "tab\tline\nbreak\r\n", "a▁b", "naïve 😀 日本語 ﬁ ​", "<s> </s> <unk> <0x41>", "x" * 300, "ab" * 200 + " token=04dbebab91ab85687d33eeaaf9ac699e1188f962" * 3,
             "word " * 40000, "Ünïcödé " * 5, "\x00\x01", "unit" + "é" * 59, "same", "same"]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = sentencepiece.tokenize(df)
    for r in out.collect():
        want = model.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want, texts[r["doc_id"]]
        assert r["round_trip"]
    back = sentencepiece.decode(out).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "").replace("▁", " ") for r in back)
    assert sentencepiece.tokenize(df.limit(0)).count() == 0


def test_viterbi(spark):
    table = {"a": -2.0, "b": -2.1, "ab": -3.0, "ba": -2.5, "aba": -4.0, "bb": -9.0}
    pieces = spark.createDataFrame([*[(p, k, k, s, 0) for k, (p, s) in enumerate(table.items())], ("", 0, sentencepiece.NO_RANK, 0.0, 0)], "piece string, id int, rank int, score double, late int")
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)] + ["axb"]
    lat = sentencepiece.lattice(spark.createDataFrame([(w,) for w in words], "unit string"), pieces, 3, scores=True)
    got = {r["unit"]: r["cuts"] for r in lat.select("unit", sentencepiece.viterbi_fold(F.col("scored"), F.col("n")).alias("cuts")).collect()}

    def score(w, cuts):
        at = [k for k in range(len(w) + 1) if cuts >> k & 1]
        return sum(table.get(w[i:j], -1e6 if j == i + 1 else -math.inf) for i, j in zip(at, at[1:]))

    for w in words:
        best = max(score(w, 1 | (m << 1) | (1 << len(w))) for m in range(1 << (len(w) - 1)))
        assert score(w, got[w]) == pytest.approx(best)


def test_unit_names_stand_for_units():
    import random

    from neurotab.llm.sentencepiece import key_of, keys, unit_of, units

    rng = random.Random(4)
    texts = [None, "", " ", "  ", "a", " a", "a ", "\n", "\n\n a", "a\n b", "a \n\tb  c", "\u2581", "a\u2581b", "x\n\u2581y"]
    texts += ["".join(rng.choice("ab  \n\t\r\x0bé\u2581"[: rng.choice([4, 7, 10])]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for t in texts:
        assert [unit_of(k) for k in keys(t)] == units(t), t
        assert all(key_of(unit_of(k)) == k for k in keys(t))


def test_groups_are_not_sent_through_the_driver(spark):
    """A few groups on disk are many once they are copied for every shard."""
    import numpy as np

    body, one = topk_search.pack(np.ones((1, 2), np.int64)), np.array([7]).tobytes()
    groups = spark.createDataFrame([(0, bytearray(one), bytearray(body), bytearray(np.array([-9]).tobytes()))], "grp long, query_ids binary, queries binary, kth binary")
    shards = spark.createDataFrame([(s, bytearray(np.array([s]).tobytes()), bytearray(body)) for s in range(3)], "shard long, ids binary, body binary")
    met = topk_search.meet(groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))), shards, 1)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in met.collect()) == [(7, s, 2) for s in range(3)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
