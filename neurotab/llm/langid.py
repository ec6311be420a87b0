"""Language identification by compression.

For each language a Zstandard raw-content dictionary is filled with training
text.  A text is encoded once with every dictionary, in frames of
``FRAME`` bytes so that a long text cannot teach the encoder its own language;
the language with the smallest total is chosen.  A narrow margin to the second
is rejected: ``accepted`` is false (the label is still the best guess).

Texts are reduced to their letters, lower-cased, in training and prediction
alike.  Only the dictionaries are bounded: they hold training documents, those
of smallest hash, at most ``DICT_DOCS`` a language, the last one cut where
``DICT_BYTES`` are reached; predictions read whole texts.

Defined results: ``und`` with score 0 for a null text or one without a letter,
or if nothing was learned; score 1 if one language was learned; equal sizes go
to the label first in code-point order.  Training rows with a null id, text or
label are left out; repeated rows count once each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.llm.common import map_batches

DICT_DOCS = 64
DICT_BYTES = 96 * 1024
MAX_LANGUAGES = 512
FRAME = 4096
LEVEL = 3
MIN_MARGIN = 0.01
# how fast confidence grows with the relative margin
SLOPE = 60.0
WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case; empty if it has no letter (signs such
    as a half or a Roman numeral sign count as letters only beside one)."""
    if not any(c.isalpha() for c in text):
        return b""
    return " ".join(WORD.findall(text)).lower().encode()


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language.  What reaches the driver is bounded by
    MAX_LANGUAGES * DICT_BYTES; the top-k per language is cut before the shuffle."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang", F.length("text").alias("n")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= DICT_DOCS)
    # ids first, texts of the few picked rows after
    ids = [(r["id"], r["lang"], r["k"]) for r in picked.select("id", "lang", "k").take(DICT_DOCS * MAX_LANGUAGES + 1)]
    if len(ids) > DICT_DOCS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not ids:
        return {}
    few = labelled.sparkSession.createDataFrame(ids, f"id {labelled.schema[doc_id].dataType.simpleString()}, lang string, k int")
    texts = rows.join(F.broadcast(few), ["id", "lang"]).select("lang", "k", F.col("text").substr(1, DICT_BYTES).alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(texts.toLocalIterator(), key=lambda r: (r["lang"], r["k"])):
        if len(out.get(r["lang"], b"")) < DICT_BYTES:
            out[r["lang"]] = (out.get(r["lang"], b"") + letters(r["text"]) + b" ")[:DICT_BYTES]
    return {k: v for k, v in sorted(out.items()) if v.strip()}


class Classifier:
    """Compressors for one worker; ``label`` gives (language, margin, score)."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as zstd

        self.compressors = []
        for lang, content in sorted(dictionaries.items()):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            # no header fields: only the coded text counts
            c = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressors.append((lang, c.compress))

    def label(self, text: str | None) -> tuple[str, float, float]:
        if not text or not self.compressors:
            return "und", 0.0, 0.0
        data = letters(text)
        if not data:
            return "und", 0.0, 0.0
        frames = [data[k:k + FRAME] for k in range(0, len(data), FRAME)]
        sizes = sorted((sum(len(compress(f)) for f in frames), lang) for lang, compress in self.compressors)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, 1.0 / (1.0 + math.exp(-SLOPE * margin))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, margin, score, accepted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded, see train()

    def run(batch: pa.RecordBatch) -> dict:
        if run.classifier is None:
            run.classifier = Classifier(shared.value)
        got = [run.classifier.label(value.as_py()) for value in batch.column(1)]
        return {"doc_id": batch.column(0), "lang_pred": [g[0] for g in got], "margin": [g[1] for g in got], "score": [g[2] for g in got],
                "accepted": [g[1] >= MIN_MARGIN for g in got]}

    run.classifier = None
    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"doc_id {kind}, lang_pred string, margin double, score double, accepted boolean")
