"""SentencePiece encoding and decoding through a relational lattice.

Encoding looks at each distinct unit (a word with the spaces before it) once:

1. units are collected from the texts, distinct per batch, cut where no piece
   holds the two neighbouring characters (a word from its comma), then distinct
   overall;
2. each unit's substrings up to the longest piece are exploded and equi-joined
   to the piece table (its size is that of the model, so it is broadcast);
3. the edges found are grouped by unit, in order of piece rank and place, and
   folded with Spark's ``aggregate`` into the unit's pieces.  For a unigram
   model the fold is Viterbi (``viterbi_fold``).  The model given here is a BPE
   model: the best sum of scores is not its encoding, so its fold
   (``merge_fold``) takes, step by step, the edge of best rank that joins two
   neighbouring symbols, until none does;
4. the parts between the cuts are looked up (characters without a piece become
   byte pieces) and written as sorted hash arrays into the shared folder;
   workers memory-map them and look up the units of a batch of texts.  No text
   is shuffled.

Units over ``LONG_UNIT`` characters (runs without any space) would need a fold
over very long arrays; workers merge them with a heap by the same rule.

Decoding joins the pieces' bytes, turns the space mark into a space and drops
the one space that encoding put in front.

Defined results: a null or empty text has no tokens; spaces are kept one by
one; the space mark (U+2581) in a text is read as a space, as the library does;
repeated rows give repeated results; tokens without a meaning in a text
(control pieces) decode to nothing; a very long text is one row, encoded whole; an
empty table gives no rows.  Of merges of equal rank the leftmost comes first.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.llm.common import as_batch, let, map_batches, write_scratch
from neurotab.session import scratch_path

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG_UNIT = 60
UNITS_A_BUCKET = 250_000
BATCH_CHARS = 1_000_000
# units that a worker holds before it passes them on, and those it cuts at once
SEEN_UNITS = 250_000
CUT_UNITS = 25_000
# no piece holds a tab or line break, and none goes on after a word into a space
UNIT = re.compile(f"{MARK}+[^{MARK}\t-\r]*|[^{MARK}\t-\r]+|[\t-\r]")
CONTROL = re.compile("([\t-\r])")
NO_RANK = (1 << 20) - 1


class Pieces:
    """The piece table of a model: [(piece, id, rank)], byte ids, decoded bytes."""

    def __init__(self, model_file: str = MODEL_FILE) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        byte_ids: dict[int, int] = {}
        normal = []
        self.decoded: list[bytes] = []
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                byte_ids[int(piece[1:-1], 16)] = k
                self.decoded.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.decoded.append(" ⁇ ".encode() if model.is_unknown(k) else b"")
            else:
                normal.append((piece, k, model.get_score(k)))
                self.decoded.append(piece.replace(MARK, " ").encode())
        order = sorted(range(len(normal)), key=lambda i: (-normal[i][2], normal[i][1]))
        self.table = [(normal[i][0], normal[i][1], rank, float(normal[i][2])) for rank, i in enumerate(order)]
        self.byte_ids = [byte_ids.get(b, model.unk_id()) for b in range(256)]
        self.longest = max(len(p) for p, *_ in self.table)
        self.rank = {p: (r, k) for p, k, r, _ in self.table}
        # neighbours inside some piece; elsewhere no merge can reach across
        inside = {p[i:i + 2] for p, *_ in self.table for i in range(len(p) - 1)}
        self.pairs = np.sort(np.fromiter(((ord(x[0]) << 21) | ord(x[1]) for x in inside), np.int64, len(inside)))

    def spell(self, unit: str, cuts: int) -> list[int]:
        """Ids of a unit that is cut at the places whose bits are set."""
        out, at = [], 0
        for k in range(1, len(unit) + 1):
            if cuts >> k & 1:
                part = unit[at:k]
                out += [self.rank[part][1]] if part in self.rank else [self.byte_ids[b] for b in part.encode()]
                at = k
        return out

    def late(self, piece: str) -> bool:
        """Whether the piece can arise from a part of worse rank than its own, so
        that its merge may have to wait for a later one."""
        rank = lambda x: -1 if len(x) == 1 else self.rank.get(x, (NO_RANK, 0))[0]
        worst = [max(rank(piece[:i]), rank(piece[i:])) for i in range(1, len(piece))]
        return any(self.rank[piece][0] < w < NO_RANK for w in worst)

    def cut(self, found: list[str]) -> tuple[list[str], np.ndarray]:
        """Units in parts that no piece can span: all parts end to end, and the
        number of parts of each unit."""
        text = "".join(found)
        if not text:
            return [], np.zeros(len(found), np.int64)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = (code[:-1] << 21) | code[1:]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        breaks = np.r_[True, self.pairs[place] != pair]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        breaks[ends[:-1]] = True
        at = np.nonzero(breaks)[0]
        parts = [text[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(text)], strict=True)]
        return parts, np.diff(np.r_[0, np.searchsorted(at, ends)])

    def merge(self, unit: str) -> list[int]:
        """Pieces of one unit by a heap of merges (best rank first, then leftmost)."""
        sym: list[str | None] = list(unit)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(sym):
                both = sym[a] + sym[b]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both][0], a, both))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            if sym[a] is None or after[a] >= len(sym) or sym[a] + sym[after[a]] != both:
                continue
            b = after[a]
            sym[a], sym[b] = both, None
            after[a] = after[b]
            if after[b] < len(sym):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [k for s in sym if s is not None for k in ([self.rank[s][1]] if s in self.rank else [self.byte_ids[b] for b in s.encode()])]

    def decode(self, ids: list[int]) -> str:
        got = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return got[1:] if got.startswith(" ") else got


@lru_cache(maxsize=4)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def units(text: str | None) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def key_of(unit: str) -> str:
    """A short name of a unit: a word after one space by itself, a tab or line
    break by itself, anything else behind a line break."""
    if unit[0] == MARK and unit[1:2] != MARK:
        return unit[1:]
    return unit if CONTROL.fullmatch(unit) else "\n" + unit


def unit_of(key: str) -> str:
    if len(key) > 1 and key[0] == "\n":
        return key[1:]
    return key if CONTROL.fullmatch(key) else MARK + key


def keys(text: str | None) -> list[str]:
    """Names of the units of a text, in order: ``units`` without a regular
    expression, where no space follows another."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return [key_of(u) for u in units(text)]
    first, *rest = CONTROL.split(text)
    out = first.split(" ")
    for sep, part in zip(rest[::2], rest[1::2], strict=True):
        out.append(sep)
        if part:
            start, *words = part.split(" ")  # no space before the first
            if start:
                out.append("\n" + start)
            out += words
    return out


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, rank, score, late), with an empty piece that keeps every unit in the join."""
    rows = [*((*row, int(pieces.late(row[0]))) for row in pieces.table), ("", 0, NO_RANK, 0.0, 0)]
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double, late int")


# an edge as one long: rank, first character, length, whether it may come late, id
PLACE_BITS, LATE_BIT, ID_BITS = 6, 27, 28


def lattice(words: DataFrame, table: DataFrame, longest: int, scores: bool = False) -> DataFrame:
    """(unit, n, edges): the pieces of two characters and more that match in each
    unit, packed, in order of rank and place; with ``scores`` also those of one
    character, and all as structs (s, l, score)."""
    # two plain explodes of numbers stay in generated code; length 0 at place 0 meets the empty piece, which keeps every unit
    n = F.length("unit")
    starts = words.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    last = F.least(F.lit(longest), F.col("n") - F.col("s"))
    lengths = F.when(F.col("s") == 0, F.sequence(F.lit(0), last)).when(last >= (1 if scores else 2), F.sequence(F.lit(1 if scores else 2), last))
    spans = starts.select("unit", "s", F.explode(lengths).alias("l"))
    found = spans.withColumn("sub", F.substring("unit", F.col("s") + 1, F.col("l"))).join(F.broadcast(table), F.col("sub") == F.col("piece"))
    number, own = F.col("rank").cast("long"), F.col("id") + F.shiftleft(F.col("late"), LATE_BIT)
    for value, bits in ((F.col("s"), PLACE_BITS), (F.col("l"), PLACE_BITS), (own, ID_BITS)):
        number = F.shiftleft(number, bits).bitwiseOR(value.cast("long"))
    kept = [F.sort_array(F.collect_list(number)).alias("edges")]
    if scores:
        kept.append(F.collect_list(F.struct("s", "l", "score")).alias("scored"))
    return found.groupBy("unit").agg(*kept).withColumn("n", n)


def place_of(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS + PLACE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def length_of(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


SIGN = -(1 << 63)


def merge_fold(edges: Column, n: Column) -> Column:
    """Places where a BPE encoding cuts a unit of at most 60 characters, as bits
    of a long.

    The rule: of the edges that join two neighbouring symbols, the one of best
    rank (then the leftmost) removes the cut inside it, until none does.  One
    pass over the edges in that order does so, as long as no merge makes an
    edge of better rank usable; only edges marked late can become so.  The
    pass looks out for that and sets the sign bit; such a unit is folded again,
    step by step from the first edge."""
    def masks(e: Column, i: Column) -> Column:
        late = F.shiftright(e, LATE_BIT).bitwiseAND(F.lit(1)) == 1
        return let(F.struct(place_of(e).alias("s"), length_of(e).alias("l")), lambda x: F.struct(
            bit(x["s"]).bitwiseOR(bit(x["s"] + x["l"])).alias("ends"), (bit(x["s"] + x["l"]) - bit(x["s"] + 1)).alias("inside"),
            late.alias("late"), i.alias("i")))

    usable = lambda m, x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(m.bitwiseAND(x["inside"])) == 1)
    start = bit(n + 1) - 1

    def one_pass(joins: Column, late: Column) -> Column:
        def merged(m: Column, x: Column) -> Column:
            return let(m.bitwiseAND(F.bitwise_not(x["inside"])), lambda after: F.when(
                F.exists(late, lambda y: (y["i"] < x["i"]) & usable(after, y)), after.bitwiseOR(F.lit(SIGN))).otherwise(after))
        return F.aggregate(joins, start, lambda m, x: F.when((m < 0) | ~usable(m, x), m).otherwise(merged(m, x)))

    def steps(joins: Column) -> Column:
        # here the sign bit marks that no edge joins anything any more: the steps left are passed over
        first = lambda m: F.get(F.filter(joins, lambda x: usable(m, x)), F.lit(0))["inside"]
        step = lambda m, _: F.when(m < 0, m).otherwise(let(first(m), lambda x: F.when(
            x.isNull(), m.bitwiseOR(F.lit(SIGN))).otherwise(m.bitwiseAND(F.bitwise_not(x)))))
        return F.aggregate(F.sequence(F.lit(1), n), start, step).bitwiseAND(F.lit((1 << 63) - 1))

    joins = F.transform(F.filter(edges, lambda e: length_of(e) >= 2), masks)
    return let(joins, lambda j: let(F.filter(j, lambda x: x["late"]), lambda late: let(
        one_pass(j, late), lambda m: F.when(m < 0, steps(j)).otherwise(m))))


def viterbi_fold(edges: Column, n: Column, unknown: float = -1e6) -> Column:
    """Cuts of the best sum of scores (unigram models), as bits of a long.  The
    state holds, per place, the best score and the cuts on the way there; a
    character without a piece costs ``unknown``; ties take the shorter piece."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts")))

    def step(state: Column, end: Column) -> Column:
        way = lambda s, score: F.struct((F.get(state, s)["score"] + score).alias("score"), s.alias("s"), F.get(state, s)["cuts"].alias("cuts"))
        ends = F.filter(edges, lambda e: (e["l"] > 0) & (e["s"] + e["l"] == end))
        known = F.transform(ends, lambda e: way(e["s"], e["score"]))
        best = F.array_max(F.concat(known, F.array(way(end - 1, F.lit(unknown)))))
        return F.concat(state, F.array(F.struct(best["score"].alias("score"), best["cuts"].bitwiseOR(bit(end)).alias("cuts"))))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), start, step), n)["cuts"]


def fold_units(words: DataFrame, table: DataFrame, pieces: Pieces, fold=merge_fold) -> DataFrame:
    """(unit, cuts) of distinct units of at most LONG_UNIT characters."""
    scores = fold is viterbi_fold
    latticed = lattice(words, table, pieces.longest, scores)
    return latticed.select("unit", fold(F.col("scored" if scores else "edges"), F.col("n")).alias("cuts"))


# a unit of 60 characters has at most 240 ids; 96 bits of two hashes name it
ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("start", "<u4"), ("n", "u1")])
UNITS_A_PARTITION = 20_000
# units that a worker keeps between batches: about 200 bytes each
CACHE_UNITS = 400_000


def unit_keys(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of units."""
    import xxhash

    raw = [u.encode() for u in found]
    return (np.fromiter((xxhash.xxh64_intdigest(u, 42) for u in raw), np.uint64, len(raw)),
            np.fromiter((xxhash.xxh3_64_intdigest(u) & 0xFFFFFFFF for u in raw), np.uint32, len(raw)))


def save(folder: str, name: str, array: np.ndarray) -> None:
    import uuid

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    part = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(array.tobytes())
    system.move(part, f"{base}/{name}")


def load(folder: str, name: str, kind) -> np.ndarray:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    info = system.get_file_info(f"{base}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.empty(0, kind)
    if system.type_name == "local":
        return np.memmap(f"{base}/{name}", kind, "r")
    with system.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def cut_units(pieces: Pieces, seen: set[str], at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """The parts of units, distinct among those cut at once."""
    rest, one = iter(seen), pa.schema([("unit", pa.string())])
    while some := list(islice(rest, at_once or CUT_UNITS)):
        yield as_batch({"unit": list({x for x in pieces.cut([unit_of(k) for k in some])[0] if len(x) <= LONG_UNIT})}, one)


def build(docs: DataFrame, text: str = "text", model_file: str = MODEL_FILE, fold=merge_fold) -> dict:
    """Encode every distinct unit of ``docs`` and write the arrays; returns
    their place."""
    spark, pieces = docs.sparkSession, pieces_of(model_file)
    shared = spark.sparkContext.broadcast(pieces)  # of the model's size

    at_once = CUT_UNITS

    def collect(batches):
        seen: set[str] = set()
        for batch in batches:
            for t in batch.column(0):
                seen.update(keys(t.as_py()))
                if len(seen) >= SEEN_UNITS:
                    yield from cut_units(shared.value, seen, at_once)
                    seen.clear()
        yield from cut_units(shared.value, seen, at_once)

    words = write_scratch(docs.select(text).mapInArrow(collect, "unit string").distinct(), "sp-units")
    n = words.count()
    buckets = max(1, -(-n // UNITS_A_BUCKET))
    # dealt by unit in parts of a set size: the edges of a part are grouped where they arise, without a further shuffle, and fit in memory
    dealt = words.repartition(max(1, -(-n // UNITS_A_PARTITION)), "unit")
    found = fold_units(dealt, piece_table(spark, pieces), pieces, fold)
    folder = scratch_path(spark, "sp-arrays")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    high = F.call_function("shiftrightunsigned", F.xxhash64("unit"), F.lit(32))
    bucket = F.shiftright(high * buckets, 32)
    done = pa.schema([("units", pa.int64())])
    width = "<u2" if len(pieces.decoded) <= 1 << 16 else "<u4"

    def write(key, batches):
        names, ids, lens = [], array("I"), array("I")
        spell = shared.value.spell
        for batch in batches:
            for unit, cuts in zip(batch.column("unit").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                own = spell(unit, cuts)
                names.append(unit)
                ids.extend(own)
                lens.append(len(own))
        h, check = unit_keys(names)
        lens = np.array(lens, np.int64)
        table = np.empty(len(h), ENTRY)
        table["hash"], table["check"], table["n"], table["start"] = h, check, lens, np.cumsum(lens) - lens
        table = table[np.lexsort((check, h))]
        save(folder, f"ids-{key[0].as_py():07d}", np.array(ids, width))
        save(folder, f"units-{key[0].as_py():07d}", table)
        yield as_batch({"units": [len(h)]}, done)

    write.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    # the units of one part are grouped by hash, without a sort
    limit = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(4 * UNITS_A_PARTITION))
    try:
        written = found.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(write, "units long").agg(F.sum("units").alias("n")).first()["n"] or 0
    finally:
        spark.conf.set(limit, before)
    if written != n:
        raise RuntimeError(f"{written} of {n} units were written")
    return {"folder": folder, "buckets": buckets, "model_file": model_file, "width": width}


class Lookup:
    """The arrays of ``build`` in one worker."""

    def __init__(self, built: dict, pieces: Pieces) -> None:
        self.built, self.pieces, self.open = built, pieces, {}
        lengths = np.fromiter(map(len, pieces.decoded), np.int64, len(pieces.decoded))
        self.spelled = np.frombuffer(b"".join(pieces.decoded), np.uint8), lengths, np.cumsum(lengths) - lengths
        self.forget()

    def forget(self) -> None:
        """Units met so far, numbered in the order of meeting, and their ids."""
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.lens = np.empty(0, self.built["width"]), np.empty(0, np.int64)

    def shard(self, bucket: int):
        if bucket not in self.open:
            if len(self.open) >= 256:
                self.open.clear()
            folder = self.built["folder"]
            self.open[bucket] = load(folder, f"units-{bucket:07d}", ENTRY), load(folder, f"ids-{bucket:07d}", self.built["width"])
        return self.open[bucket]

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids end).  Units of earlier texts stay
        known until there are CACHE_UNITS of them."""
        if len(self.lens) > CACHE_UNITS:
            self.forget()
        numbers = [list(map(self.number.__getitem__, keys(t))) for t in texts]
        new = [unit_of(k) for k in islice(self.number, len(self.lens), None)]
        if new:
            flat, n = self.whole(new)
            self.flat, self.lens = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.lens, n])
        own = np.fromiter(chain.from_iterable(numbers), np.int64)
        ids, lens = gather(self.flat, self.lens, own)
        ends = np.cumsum(lens)[np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers))) - 1] if len(lens) else np.zeros(len(numbers), np.int64)
        # a text without units ends where the one before it does
        return ids, np.maximum.accumulate(np.where([bool(n) for n in numbers], ends, 0))

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        data, lengths, start = self.spelled
        n = lengths[ids]
        stop = np.cumsum(n)
        spelled = data[np.repeat(start[ids] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        at = np.r_[0, stop][np.r_[0, ends]].tolist()
        return [spelled[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def whole(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per unit) of units before they are cut."""
        number: dict[str, int] = {}
        split, parts = self.pieces.cut(found)
        own = np.array([number.setdefault(x, len(number)) for x in split], np.int64)
        flat, n = self.ids(list(number))
        ids, lens = gather(flat, n, own)
        return ids, np.add.reduceat(lens, np.cumsum(parts) - parts) if len(parts) else lens

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per unit) of distinct cut units, in order."""
        long = [k for k, u in enumerate(found) if len(u) > LONG_UNIT]
        merged = [self.pieces.merge(found[k]) for k in long]
        short = np.setdiff1d(np.arange(len(found)), np.array(long, np.int64))
        h, check = unit_keys([found[k] for k in short.tolist()])
        order = np.argsort(h, kind="stable")
        h, check = h[order], check[order]
        target = ((h >> np.uint64(32)) * np.uint64(self.built["buckets"])) >> np.uint64(32)
        edges = np.nonzero(np.r_[True, target[1:] != target[:-1], True])[0] if len(h) else [0]
        flat, n = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            table, ids = self.shard(int(target[lo]))
            place = np.searchsorted(table["hash"], h[lo:hi])
            while True:  # equal first hashes stand side by side
                got = table[np.minimum(place, len(table) - 1)]
                if (got["hash"] != h[lo:hi]).any():
                    raise KeyError(f"unit {found[short[order[lo + int((got['hash'] != h[lo:hi]).argmax())]]]!r} was not encoded")
                other = got["check"] != check[lo:hi]
                if not other.any():
                    break
                place[other] += 1
            lens = got["n"].astype(np.int64)
            flat.append(ids[np.repeat(got["start"], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)])
            n.append(lens)
        flat.append(np.array([x for m in merged for x in m], np.int64))
        n.append(np.fromiter(map(len, merged), np.int64, len(merged)))
        # back from the order of the hashes, long units last, to the order asked for
        where = np.empty(len(found), np.int64)
        where[short[order]] = np.arange(len(short))
        where[np.array(long, np.int64)] = len(short) + np.arange(len(long))
        return gather(np.concatenate(flat).astype("<u4"), np.concatenate(n), where)


def gather(flat: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``own``, end to end, and their lengths; list k is the
    k-th stretch of ``flat``, n[k] long."""
    start, lens = np.cumsum(n) - n, n[own]
    return flat[np.repeat(start[own], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)], lens


def round_trip(decoded: bytes, text: str | None) -> bool:
    """Whether a text's ids give the text back, behind the one space put in front."""
    want = (text or "").replace(MARK, " ")
    return decoded.removeprefix(b" ") == want.encode("utf-8", "surrogatepass") or decoded.decode("utf-8", "replace").removeprefix(" ") == want


def encode(docs: DataFrame, built: dict, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and round_trip (whether the
    ids decode to the text)."""
    added = {"ids": "array<int>", "n_tokens": "long", "round_trip": "boolean"}
    keep = [c for c in docs.columns if c not in added]
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)])
    body = names[keep.index(text)]

    def run(batch: pa.RecordBatch):
        if run.lookup is None:
            run.lookup = Lookup(built, shared.value)
        lookup, texts, held, at = run.lookup, [], 0, 0
        for k, value in enumerate(batch.column(body), 1):
            texts.append(value.as_py())
            held += len(texts[-1] or "")
            if held >= BATCH_CHARS or k == batch.num_rows:
                flat, ends = lookup.encoded(texts)
                same = [round_trip(b, t) for b, t in zip(lookup.decoded(flat, ends), texts, strict=True)]
                ends = np.r_[0, ends].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                yield {n: batch.column(n).slice(at, k - at) for n in names} | {"ids": ids, "n_tokens": np.diff(ends).astype(np.int64), "round_trip": same}
                texts, held, at = [], 0, k

    shared = docs.sparkSession.sparkContext.broadcast(pieces_of(built["model_file"]))  # of the model's size
    run.lookup = None
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    out = map_batches(rows, run, kinds + ", " + ", ".join(f"{n} {t}" for n, t in added.items()))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *added)


def decode(tokens: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """``tokens`` with the decoded text of each row (null ids: null), as ``decoded``."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces_of(model_file))
    schema = tokens.drop("decoded").schema
    names = schema.names

    def run(batch: pa.RecordBatch) -> dict:
        got = [None if x.as_py() is None else shared.value.decode(x.as_py()) for x in batch.column(ids)]
        return {n: batch.column(n) for n in names} | {"decoded": got}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_batches(tokens.drop("decoded"), run, kinds + ", decoded string")


def tokenize(docs: DataFrame, text: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """Build the arrays from ``docs`` and encode them."""
    return encode(docs, build(docs, text, model_file), text)
