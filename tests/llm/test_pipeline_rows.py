"""All rows of the pipeline against plain Python, stage by stage."""

import hashlib
import math
from collections import Counter, defaultdict

import regex
import sentencepiece
import xxhash

import corpus_pipeline
from neurotab.llm import quality
from neurotab.llm.sentencepiece import MODEL_FILE

SMALL = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
MARKS = regex.compile(r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+")


def line_stays(line):
    marks, words = len(MARKS.sub("", line)), len(WORD.findall(line))
    separators = sum(c in quality.NAVIGATION_SEPARATORS for c in line)
    noise = marks * 100 > len(line.replace(" ", "")) * quality.MAX_PUNCTUATION_PCT
    navigation = marks >= 3 and separators >= quality.MIN_SEPARATORS and separators * 5 >= words
    boilerplate = len(line) <= quality.BOILERPLATE_CHARS and any(p in line.lower() for p in quality.BOILERPLATE)
    return not (noise or navigation or boilerplate)


def cleaned(text):
    """(kept, text without failing lines)"""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    repeated = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    lines = text.split("\n")
    good = [x for x in lines if line_stays(x)]
    out = "\n".join(good) if len(good) < len(lines) else text
    lost = len(w) - len(WORD.findall(out))
    return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and 100 * lost <= 30 * len(w), out


def fingerprint(text):
    w = WORD.findall(regex.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def one_of_each(rows):
    fps = {i: fingerprint(t) for i, t, _ in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def without_repeats(rows):
    first = {}
    for i, t, _ in sorted(rows):
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    out = []
    for i, t, s in rows:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t, s))
    return out


def mixed(rows):
    """How often each document is taken."""
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    sources = sorted(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(total.values())
    while open_:  # sources over their cap leave, the rest share again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    copies = {}
    for s in sources:
        ratio = target[s] / total[s] if total[s] else 0.0
        whole, p = math.floor(ratio), ratio - math.floor(ratio)
        order = []
        for i, _, own in rows:
            if own == s:
                copies[i] = whole if size[i] else 0
                u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                if size[i] and 0 < p < 1:
                    order.append((u / (1 - u) * (1 - p) / p, i))
        budget, before = target[s] - whole * total[s], 0
        for _, i in sorted(order):
            copies[i] += before * 2 + size[i] <= budget * 2
            before += size[i]
    return [r for r in rows for _ in range(copies[r[0]])]


def test_all_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = []
    for r in docs:
        kept, text = cleaned(r["text"] or "")
        if kept:
            rows.append((r["doc_id"], text, r["source"]))
    assert 0 < len(rows) < len(docs)
    alone = one_of_each(rows)
    assert len(alone) < len(rows)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    want = Counter((i, t, s, len(t), tuple(model.encode(t))) for i, t, s in mixed(without_repeats(alone)))
    got = Counter((r["doc_id"], r["text"], r["source"], r["n_chars"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert set(got) == set(want) and got == want


def test_quality_verdicts(spark):
    """kept, lost words and cleaned text of the line rules, on a larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    for r in docs.collect():
        kept, text = cleaned(r["text"] or "")
        q = got[r["doc_id"]]
        assert (q["kept"], q["clean_text"], q["n_lost_words"]) == (kept, text, len(WORD.findall(r["text"] or "")) - len(WORD.findall(text)))
