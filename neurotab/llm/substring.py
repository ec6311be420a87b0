"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage is repeated where ``WINDOW`` consecutive words of a document also
stand in a document with a smaller id.  The suffixes that can show this are cut
to what matters and split by prefix:

* suffixes are sampled at anchors: the ``PREFIX``-word sequence of smallest
  hash in each window.  Equal windows have equal anchors, so the suffix that
  starts at the anchor stands for all windows around it; consecutive windows
  with one anchor travel as one run of words (13 to 21 words);
* documents are dealt into chunks by a hash of their id, text and place in the
  input, so that neither an id of many rows nor many equal rows are a group;
  rows without an id or with a text too short for a window are answered where
  they are read;
* first a chunk tells the prefixes of its runs, four bytes each, and how many
  words stand behind them.  A prefix that only one run has, over all chunks,
  does not branch: its runs go no further.  Of the others those with more than
  ``SUBTREE_WORDS`` words behind them are made longer: their windows travel one
  by one and are dealt by all their words.  The counts are of all documents;
* then a chunk sends each distinct run of a branching prefix once, with the
  smallest and largest id it has there, to the bucket of the prefix, so a bucket
  holds whole subtrees and fits in memory: a passage in a third of all documents
  is one row a chunk.  In the bucket the tree nodes of the suffixes are numbered
  level by level (1, 2, 4, 8, 12, 13 words); windows with the same node at depth
  13 are one repeat, whose smallest id is kept.  Where a bucket still is larger
  than ``SUBTREE_WORDS``, its parts are built one after another;
* the smallest ids go back to the chunk, for runs where a larger id saw it.
  Neighbouring windows join into maximal repeats, and covered words go.

Hashes only choose what travels and where; nodes are numbered from the words.

Defined results: a null text has no words; documents with a null id are left
whole and count for none; rows with one id never remove each other; repeated
rows repeat in the result; texts under 13 words are never touched; a very long
text is one row of its chunk and is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import as_batch, map_batches, set_aside, text_bytes, write_scratch
from neurotab.llm.packing import expand, squeeze

WINDOW = 13
PREFIX = 5
CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 1_500_000
SUBTREE_WORDS = 6_000_000
ANCHORS_A_BUCKET = 2_000_000
CHUNKS_A_TASK = 8


# place of a window's anchor in the low bits of its order: the leftmost of equal hashes is the smallest
PLACE_BITS = 31
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
HASH_WORDS, LONG_WORD = 8192, 4096


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(w: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, many words at a time.  It picks
    anchors and buckets; words are never compared by it."""
    out = np.empty(len(w), np.uint64)
    for at in range(0, len(w), HASH_WORDS):
        part = w[at:at + HASH_WORDS]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        if lens.max() > LONG_WORD:
            part = [x if len(x) <= LONG_WORD else hashlib.sha256(x).digest() for x in part]
            lens = np.fromiter(map(len, part), np.int64, len(part))
        raw = np.frombuffer(b"".join(part), np.uint8)
        up, down = powers(1 << max(16, (len(raw) - 1).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
        ends = np.cumsum(lens)
        h = (sums[ends] - sums[ends - lens]) * down[ends - lens]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[at:at + HASH_WORDS] = h ^ (h >> np.uint64(29))
    return out


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the anchor of every window, from the hashes of a text's words,
    and the hashes of all sequences that can be one."""
    n = len(h) - PREFIX + 1
    g = h[:n].copy()
    for k in range(1, PREFIX):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(BASE) + h[k:n + k]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64((1 << PLACE_BITS) - 1)
    order = (g & ~low) | np.arange(n, dtype=np.uint64)
    span, width = order, 1
    while width * 2 <= WINDOW - PREFIX + 1:  # smallest of 1, 2, 4, 8 neighbours
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    rest = WINDOW - PREFIX + 1 - width
    span = np.minimum(span[:len(span) - rest], span[rest:]) if rest else span
    return (span & low).astype(np.int64), g


def runs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, words and anchor of each run of a text, and the hash of its prefix."""
    place, g = anchors(h)
    starts = np.nonzero(np.diff(place, prepend=-1))[0]
    at = place[starts]
    return starts, np.diff(starts, append=len(place)) + (WINDOW - 1), at, g[at]


def lengthened(h: np.ndarray, long: np.ndarray, starts: np.ndarray, n: np.ndarray, at: np.ndarray, g: np.ndarray) -> tuple:
    """``runs_of`` a text with each ``long`` run cut into its windows, which have
    the hash of all their words."""
    if not long.any():
        return starts, n, at, g
    times = np.where(long, n - (WINDOW - 1), 1)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts, n, at, g, long = (np.repeat(x, times) for x in (starts, n, at, g, long))
    starts, n = starts + step, np.where(long, WINDOW, n)
    some = starts[long]
    key = h[some]
    for k in range(1, WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(BASE) + h[some + k]
    g[long] = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, n, at, g


def dealt(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each prefix hash and 32 other bits of it.  An anchor's hash is
    the smallest of several, so its high bits alone would favour the first buckets."""
    mixed = g * np.uint64(BASE)
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def in_order(ids: list, texts: list) -> list[int]:
    """The rows of a chunk in an order that every pass repeats."""
    return sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))


def tell_prefixes(texts: list, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, pack) of a chunk's prefixes: 32 bits of each distinct one, the
    words of its runs, and whether several runs have it."""
    found = [runs_of(word_hashes(w)) for w in (t.split() for t in texts) if len(w) >= WINDOW]
    if not found:
        return
    bucket, key = dealt(np.concatenate([f[3] for f in found]), buckets)
    both, place, times = np.unique(bucket.astype(np.uint64) << np.uint64(32) | key, return_inverse=True, return_counts=True)
    words = np.bincount(place, np.concatenate([f[1] for f in found])).astype(np.uint32)
    target = (both >> np.uint64(32)).astype(np.int64)
    edges = np.nonzero(np.diff(target, prepend=-1, append=-2))[0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(target[lo]), squeeze((both[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32), words[lo:hi], times[lo:hi] > 1)


def branching(bodies: list[bytes]) -> list[bytes]:
    """For each chunk's pack its prefixes that several runs have, over all
    chunks, and which of them are too large for one subtree."""
    packs = [expand(b) for b in bodies]
    key, words, many = (np.concatenate(x) for x in zip(*packs, strict=True))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = (times > 1) | (np.bincount(place, many) > 0)
    large = np.bincount(place, words) > SUBTREE_WORDS
    out, at = [], 0
    for keys, *_ in packs:
        own = place[at:at + len(keys)]
        keep = shared[own]
        out.append(squeeze(keys[keep], large[own][keep]))
        at += len(keys)
    return out


class Shared:
    """The branching prefixes of one chunk."""

    def __init__(self, answers: list[tuple[int, bytes]], buckets: int) -> None:
        parts = [(np.uint64(b) << np.uint64(32) | keys.astype(np.uint64), large) for b, (keys, large) in ((b, expand(body)) for b, body in sorted(answers))]
        self.buckets = buckets
        self.keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        self.large = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, bool)

    def of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which prefixes branch, and which of them are large."""
        if not len(self.keys):
            return np.zeros(len(g), bool), np.zeros(len(g), bool)
        bucket, key = dealt(g, self.buckets)
        both = bucket.astype(np.uint64) << np.uint64(32) | key
        place = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
        hit = self.keys[place] == both
        return hit, hit & self.large[place]


class Chunk:
    """The distinct runs of a chunk's branching prefixes.  Numbers are kept in
    packed arrays: what grows with the chunk is its distinct run texts and a few
    bytes for each run."""

    def __init__(self, ids: list, texts: list, buckets: int, shared: Shared) -> None:
        self.docs: list[tuple] = []  # (place in the order, run starts, run numbers) of documents with such runs
        self.runs: dict[bytes, int] = {}
        self.low, self.high = array("q"), array("q")
        self.bucket, self.words, self.anchor = array("q"), array("B"), array("B")
        for place, row in enumerate(in_order(ids, texts)):
            w = texts[row].split()
            if len(w) < WINDOW:
                continue
            h = word_hashes(w)
            starts, n, at, g = runs_of(h)
            some, large = shared.of(g)
            if not some.any():
                continue
            starts, n, at, g = lengthened(h, large[some], starts[some], n[some], at[some], g[some])
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            numbers, new = self.number(b" ".join(w), np.r_[0, ends][starts].tolist(), (ends[starts + n - 1] - 1).tolist(), ids[row])
            if new:
                self.bucket.frombytes(dealt(g[new], buckets)[0].tobytes())
                self.words.frombytes(n[new].astype(np.uint8).tobytes())
                self.anchor.frombytes((at[new] - starts[new]).astype(np.uint8).tobytes())
            self.docs.append((place, starts, numbers))

    def number(self, joined: bytes, begin: list[int], end: list[int], who: int) -> tuple[np.ndarray, list[int]]:
        """Numbers of a document's runs, and which of them are new."""
        runs, high, numbers, new = self.runs, self.high, [], []
        for k, (a, b) in enumerate(zip(begin, end, strict=True)):
            text = joined[a:b]
            run = runs.get(text)
            if run is None:
                run = runs[text] = len(runs)
                high.append(who)
                new.append(k)
            else:  # rows come in the order of their ids
                high[run] = who
            numbers.append(run)
        self.low.extend([who] * len(new))
        return np.array(numbers, np.int32), new

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its runs in order)."""
        bucket = np.frombuffer(self.bucket, np.int64) if self.bucket else np.empty(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
        yield from zip(bucket[order][edges].tolist(), np.split(order, edges[1:]), strict=True) if len(edges) else ()

    def packed(self) -> Iterator[tuple[int, bytes]]:
        texts = list(self.runs)
        facts = [np.frombuffer(x, k) if x else np.empty(0, k) for x, k in ((self.words, np.uint8), (self.anchor, np.uint8), (self.low, np.int64), (self.high, np.int64))]
        for bucket, runs in self.by_bucket():
            words, anchor, low, high = (x[runs] for x in facts)
            yield bucket, squeeze(np.diff(runs, prepend=0).astype(np.uint32), words, anchor, low, high - low, np.frombuffer(b"\n".join([texts[r] for r in runs.tolist()]), np.uint8))


    def places(self) -> bytes:
        """Where the runs stand: documents, their runs, starts and numbers."""
        count = [len(d[1]) for d in self.docs]
        return squeeze(np.array([d[0] for d in self.docs], np.uint32), np.array(count, np.uint32),
                       *[np.concatenate([d[k] for d in self.docs]).astype(np.uint32) if self.docs else np.empty(0, np.uint32) for k in (1, 2)])


def numbered(*keys: np.ndarray) -> np.ndarray:
    """Dense numbers of the tuples of keys: children of tree nodes."""
    both = keys[0].astype(np.int64)
    for k in keys[1:]:
        both = np.unique(both * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return both


def window_nodes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the tree node at depth 13 of each suffix in ``starts``."""
    one = words.astype(np.int64)
    two = numbered(one[:-1], one[1:])
    four = numbered(two[:-2], two[2:])
    eight = numbered(four[:-4], four[4:])
    return numbered(numbered(eight[starts], four[starts + 8]), one[starts + 12])


def smallest(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix, the smallest id at its node."""
    order = np.argsort(nodes, kind="stable")
    first = np.nonzero(np.diff(nodes[order], prepend=-1))[0]
    low = np.minimum.reduceat(ids[order], first)
    out = np.empty_like(ids)
    out[order] = np.repeat(low, np.diff(np.r_[first, len(order)]))
    return out


def subtrees(runs: list[bytes], lens: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Smallest id at the depth-13 node of every window of every run, in order."""
    total = int(lens.sum())
    parts = -(-total // SUBTREE_WORDS)
    n = lens - (WINDOW - 1)
    if parts <= 1:
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(x, len(number)) for run in runs for x in run.split(b" ")), np.int64, total)
        begin = np.cumsum(lens) - lens
        starts = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return smallest(window_nodes(flat, starts), np.repeat(low, n))
    # longer prefixes: windows are split by their first words, one part at a time
    import zlib

    parts *= 8
    out, windows = np.empty(n.sum(), np.int64), (run[k:k + WINDOW] for run in (text.split(b" ") for text in runs) for k in range(len(run) - WINDOW + 1))
    part = np.fromiter((zlib.crc32(b" ".join(w[:8])) % parts for w in windows), np.int64, int(n.sum()))
    owner, first = np.repeat(np.arange(len(runs)), n), np.cumsum(n) - n
    order = np.argsort(part, kind="stable")
    for place in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        number = {}
        words = (x for o, k in zip(owner[place].tolist(), (place - first[owner[place]]).tolist(), strict=True) for x in runs[o].split(b" ", k + WINDOW)[k:k + WINDOW])
        flat = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, WINDOW * len(place))
        out[place] = smallest(window_nodes(flat, np.arange(len(place)) * WINDOW), low[owner[place]])
    return out


def solve_bucket(bodies: list[bytes]) -> list[bytes | None]:
    """For each chunk's pack, the packed (run number, windows, smallest ids) of
    runs that hold a window with an id smaller than their largest."""
    import xxhash

    runs: list[bytes] = []
    facts = []
    for body in bodies:
        step, *about, text = expand(body)
        runs += text.tobytes().split(b"\n")
        facts.append((np.cumsum(step), *about))
    counts = [len(f[0]) for f in facts]
    own, lens, anchor, low, more = (np.concatenate(x).astype(np.int64) for x in zip(*facts, strict=True))
    # a prefix that one run has alone does not branch; the hash only puts runs aside
    prefix = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run.split(b" ", a + PREFIX)[a:a + PREFIX])) for run, a in zip(runs, anchor.tolist(), strict=True)), np.uint64, len(runs))
    _, place, times = np.unique(prefix, return_inverse=True, return_counts=True)
    branched = np.nonzero(times[place] > 1)[0]
    n = lens - (WINDOW - 1)
    # runs alone may still be held by several documents of their chunk
    found = np.repeat(low, n)
    if len(branched):
        some = subtrees([runs[k] for k in branched.tolist()], lens[branched], low[branched])
        found[np.repeat(np.isin(np.arange(len(runs)), branched), n)] = some
    begin = np.cumsum(n) - n
    told = np.minimum.reduceat(found, begin) < low + more
    out, at = [], 0
    for c in counts:
        mine = at + np.nonzero(told[at:at + c])[0]
        parts = [found[begin[k]:begin[k] + n[k]] for k in mine.tolist()]
        out.append(squeeze(own[mine].astype(np.uint32), n[mine].astype(np.uint8), np.concatenate(parts)) if parts else None)
        at += c
    return out


def removed(ids: list, order: list[int], places: bytes | None, answers: list[bytes]) -> dict[int, np.ndarray]:
    """First words of the windows to remove, by row, of the documents that have any."""
    known: dict[int, np.ndarray] = {}
    for body in answers:
        numbers, n, low = expand(body)
        known.update(zip(numbers.tolist(), np.split(low, np.cumsum(n.astype(np.int64))[:-1]), strict=True))
    if places is None or not known:
        return {}
    place, count, starts, numbers = expand(places)
    out, at = {}, 0
    for row, n in zip((order[p] for p in place.tolist()), count.tolist(), strict=True):
        hits = [s + np.nonzero(known[run] < ids[row])[0] for s, run in zip(starts[at:at + n].tolist(), numbers[at:at + n].tolist(), strict=True) if run in known]
        if hits and sum(map(len, hits)):
            out[row] = np.concatenate(hits)
        at += n
    return out


def mask_of(n: int, windows: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, spans (word ranges removed), kept_text
    (kept words joined by one space; null for a null text) and kept_sha256."""
    added = {"n_words": "long", "n_removed": "long", "spans": "array<array<long>>", "kept_text": "string", "kept_sha256": "string"}
    keep = [c for c in docs.columns if c not in added]
    names = [f"c{k}" for k in range(len(keep))]  # names of the input never clash with ours
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)])
    key, body = names[keep.index(doc_id)], names[keep.index(text)]
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    # a run for each five words of six bytes, and 3.4 words travel for each word at most; windows of
    # a long prefix take up to six times the words of their run, which are then dealt more thinly
    anchor_buckets = max(1, math.ceil(size / 30 / ANCHORS_A_BUCKET))
    buckets = max(1, math.ceil(size / 6 * 3.4 / BUCKET_WORDS))
    # the number of tasks follows the number of groups
    tasks = lambda groups: max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups / CHUNKS_A_TASK))
    # 13 words have 25 bytes at least
    grouped = rows[key].isNotNull() & (F.coalesce(F.octet_length(body), F.lit(0)) >= 2 * WINDOW - 1)
    salt = F.shiftright(F.monotonically_increasing_id(), 6)  # equal rows are many groups as well
    alone, rows = rows.where(~grouped), rows.where(grouped).withColumn("chunk", F.pmod(F.xxhash64(key, body, salt), F.lit(chunks)))
    by_chunk = rows.repartition(tasks(chunks), "chunk")

    def read(batches) -> tuple[list, list]:
        ids, texts = [], []
        for b in batches:
            ids += b.column(key).to_pylist()
            texts += text_bytes(b.column(body))
        return ids, texts

    sent = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])

    def packs(chunk: list[int], bucket: list[int], body: list[bytes]) -> pa.RecordBatch:
        return as_batch({"chunk": chunk, "bucket": bucket, "body": body}, sent)

    def tell(k, batches):
        _, texts = read(batches)
        for bucket, body in tell_prefixes(texts, anchor_buckets):
            yield packs([k[0].as_py()], [bucket], [body])

    def answered(solver):
        def solve(k, batches):
            chunk_ids, bodies = [], []
            for b in batches:
                chunk_ids += b.column("chunk").to_pylist()
                bodies += b.column("body").to_pylist()
            got = [(c, a) for c, a in zip(chunk_ids, solver(bodies), strict=True) if a is not None]
            yield packs([c for c, _ in got], [k[0].as_py()] * len(got), [a for _, a in got])
        solve.__annotations__ = types | {"k": types["key"]}
        return solve

    def send(k, left: pa.Table, right: pa.Table) -> pa.Table:
        shared = Shared(list(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True)), anchor_buckets)
        if not len(shared.keys):
            return sent.empty_table()
        chunk = Chunk(*read(left.to_batches()), buckets, shared)
        made = [packs([k[0].as_py()], [bucket], [body]) for bucket, body in chunk.packed()]
        return pa.Table.from_batches([*made, packs([k[0].as_py()], [-1], [chunk.places()])], sent)

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    schema = kinds + ", " + ", ".join(f"{n} {t}" for n, t in added.items())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def filled(texts: list, windows: dict[int, np.ndarray]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in added}
        for row, text in enumerate(texts):
            w = (text or b"").split()
            gone = mask_of(len(w), windows[row]) if row in windows else None
            kept = b" ".join(w if gone is None else [x for x, g in zip(w, gone.tolist(), strict=True) if not g])
            edges = [] if gone is None else np.nonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))[0].reshape(-1, 2).tolist()
            count = 0 if gone is None else int(gone.sum())
            for c, v in zip(added, (len(w), count, edges, None if text is None else kept, hashlib.sha256(kept).hexdigest()), strict=True):
                out[c].append(v)
        out["kept_text"] = pa.array(out["kept_text"], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return out

    def apply(k, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = read(left.to_batches())
        replies = list(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True))
        places = next((x for b, x in replies if b < 0), None)
        windows = removed(ids, in_order(ids, texts) if places else [], places, [x for b, x in replies if b >= 0])
        return pa.Table.from_batches([as_batch({n: left.column(n) for n in names} | filled(texts, windows), arrow)])

    def whole(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in names} | filled(list(text_bytes(batch.column(body))), {})

    types = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    tell.__annotations__ = types | {"k": types["key"]}
    for f in (send, apply):
        f.__annotations__ = {"k": types["key"], "left": pa.Table, "right": pa.Table, "return": pa.Table}
    send_schema = "chunk long, bucket long, body binary"
    by_bucket = lambda df, n, solver: df.repartition(tasks(n), "bucket").groupBy("bucket").applyInArrow(answered(solver), send_schema)
    told = by_chunk.groupBy("chunk").applyInArrow(tell, send_schema)
    shared = by_bucket(told, anchor_buckets, branching)
    runs = write_scratch(by_chunk.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send, send_schema), "runs")
    back = by_bucket(runs.where("bucket >= 0"), buckets, solve_bucket).unionAll(runs.where("bucket < 0"))
    result = by_chunk.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(apply, schema).unionAll(map_batches(alone, whole, schema))
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *added)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Documents without their repeated passages; same columns as ``docs`` (an
    ``n_chars`` column follows the text).  Untouched texts stay as they are,
    changed ones keep their other words joined by one space."""
    aside, names = set_aside(docs, "doc_id", "text")
    out = remove_repeats(aside)
    changed = F.col("n_removed") > 0
    columns = {c: F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)}
    if "n_chars" in columns:
        old = F.col(names[docs.columns.index("n_chars")])
        columns["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(old).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    columns["text"] = F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    return out.select(*columns.values())
