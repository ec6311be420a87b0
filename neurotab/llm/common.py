"""Shared helpers of the text operators: words, scratch tables, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.session import scratch_path

# the separators of a word, as a Java character class; bytes.split() without
# an argument splits at exactly the same six bytes
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table (column pruning reaches the scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: empty array).
    Splitting at one plain character avoids the regex engine."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: each word and the space after it
    becomes one character."""
    body = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.length(F.regexp_replace(body, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row: the optimiser would
    otherwise inline an expression into each of its uses, also into lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all but the needed columns renamed, so that no name clashes
    with an operator's own; the new names stand in the order of the columns."""
    names = [c if c in needed else f"__aside_{k}" for k, c in enumerate(docs.columns)]
    return docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]), names


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, and
    gives the planner the true size of the result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, *, flush=None) -> DataFrame:
    """``mapInArrow`` for functions that turn one batch into columns (a dict of
    lists or Arrow arrays); ``flush`` may yield more at the end of a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield as_batch(columns, arrow)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in arrow:
        value = columns[field.name]
        if isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value
            arrays.append(value if value.type == field.type else value.cast(field.type))
        else:
            arrays.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    import pyarrow.compute  # noqa: F401  (registers casts)

    for value in column.cast(pa.large_binary()):
        yield value.as_py()
