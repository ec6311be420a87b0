"""Mixing sources to target weights by Pareto order sampling (native).

Every source gets a target in words: a weighted share of the whole budget, but
never more than ``max_copies`` times its own size; what a capped source cannot
use is shared again by weight.  A source with target T and size S takes each of
its documents ``floor(T / S)`` times for certain; the rest of the target is a
random sample without replacement in which a document's inclusion probability
p is the fraction left.  The sample is drawn by Pareto order sampling: each
document gets the rank value  u/(1-u) * (1-p)/p  and the smallest are taken
until the words left are used up (the document at the edge is taken if at
least half of it fits), so the size of the sample is fixed and the
probabilities may differ from row to row.

Rows of one source with the same id and size are taken together.

The cut is found without sorting a source: rank values fall into
``BINS`` bins, words are summed per (source, bin), and only documents of the
one bin that holds the cut are ordered.  u comes from a hash of the id, so a
rerun gives the same mix.

Defined results: a null text or a text without words has size 0 and is taken
0 times; a null source is a source of its own, ordered last; repeated rows share
their rank value and fate; extra columns of ``docs``, whatever their names,
pass ``apply_mix`` unchanged; an empty table gives an empty mix; a very long text
is one row like any other, counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.llm.common import word_count, write_scratch

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
BUDGET_PCT = 150
MAX_COPIES = 2
BINS = 1 << 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_pct: int = BUDGET_PCT,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: (source, source_size) -> weight and target.

    Water filling in closed form: sources in the order of cap / weight; the
    first k are capped, the others share what is left by weight.  k is the
    first count whose water level does not pass the next source's cap."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights)) + 1)
    caps = ranked.withColumn("weight", weight).withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = (
        caps.withColumn("_budget", (F.sum("source_size").over(everything) * budget_pct).cast("double") / 100)
        .withColumn("_level", level)
        # the level at the first source that is not capped
        .withColumn("_final", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_i", "_level"))).over(everything))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final._level") * F.col("weight"), F.col("_cap")))
    return filled.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone (52 bits of its MD5)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def pareto_value(u: Column, p: Column) -> Column:
    return u / (1.0 - u) * (1.0 - p) / p


def order_key(inclusion: Column, u: Column, doc_id: Column, size: Column) -> Column:
    """Sort key of the sample: (bin, Pareto value, id, size); null for rows that
    are certain to stay out of it."""
    q = pareto_value(u, inclusion)
    key = F.struct(F.floor(q / (1.0 + q) * BINS).alias("bin"), q.alias("q"), doc_id.alias("id"), size.alias("size"))
    return F.when((inclusion > 0) & (inclusion < 1) & (size > 0), key)


def sample_cuts(rows: DataFrame, strata: DataFrame, seed: str) -> DataFrame:
    """``strata`` (source, ..., p, budget) with ``cut``: the order key of the last
    row that the sample takes (null: it takes none).

    rows: (doc_id, source, size).  Bin sums combine before the shuffle, so a hot
    stratum ships at most BINS rows a task; only the rows of its cut bin, one
    in BINS, are put in order."""
    keyed = with_strata(rows, strata).withColumn("_key", order_key(F.col("p"), uniform(F.lit(seed), F.col("doc_id")), F.col("doc_id"), F.col("size")))
    keyed = keyed.filter("_key is not null")
    by = ["_source"]
    bins = keyed.groupBy(F.col("source").alias("_source"), F.col("_key.bin").alias("_bin")).agg(F.sum("size").alias("_n"), F.first("budget").alias("_budget"))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = bins.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # the bin in which the budget ends, or the last one if it never does
    last = F.max(F.when(F.col("_before") < F.col("_budget"), F.struct("_bin", "_before")))
    edges = write_scratch(summed.groupBy(*by).agg(last.alias("_edge")).filter("_edge is not null"), "mix-edges")
    at_edge = keyed.join(edges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key.bin") == F.col("_edge._bin")))
    running = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("_edge._before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    fits = at_edge.withColumn("_fits", so_far * 2 + F.col("size") <= F.col("budget") * 2)
    # nothing in the edge bin fits: the cut is the lower end of that bin
    none = F.struct(F.col("_bin").alias("bin"), F.lit(-1.0).alias("q"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("id"),
                    F.lit(0).cast("long").alias("size"))
    cuts = fits.groupBy("_source").agg(F.max(F.when(F.col("_fits"), F.col("_key"))).alias("_last"), F.first("_edge._bin").alias("_bin"))
    cuts = cuts.select("_source", F.coalesce(F.col("_last"), none).alias("cut"))
    return strata.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def with_strata(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Join on the source, nulls equal.  ``strata`` is a written table of known
    size: the planner broadcasts it while it is small and sort-merge joins
    (with AQE splitting a hot source) beyond that."""
    other = strata.withColumnRenamed("source", "_name")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")


def plan_mix(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """Per source: source_size, target, whole, p, budget, cut.  rows: (doc_id, source, size)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    strata = source_targets(sums).withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    strata = strata.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight")
    strata = write_scratch(strata, "mix-strata")
    return write_scratch(sample_cuts(rows, strata, seed), "mix-plan")


def take(rows: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (doc_id, source, size and any more) with source_size, target,
    copies and taken; decided row by row, without a shuffle of the rows while
    the plan is small."""
    planned = with_strata(rows, plan)
    key = order_key(F.col("p"), uniform(F.lit(seed), F.col("doc_id")), F.col("doc_id"), F.col("size"))
    sampled = F.coalesce(key <= F.col("cut"), F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole") + sampled).otherwise(0).cast("long")
    return planned.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("whole", "p", "budget", "cut")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every document, written once."""
    return write_scratch(docs.select("doc_id", "source", word_count(docs[text]).cast("long").alias("size")), "mix-sizes")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per document."""
    rows = sizes(docs, text)
    return take(rows, plan_mix(rows))


def apply_mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixed documents, each as often as it is taken; same columns as ``docs``."""
    plan = plan_mix(sizes(docs, text))
    names = [f"_c{k}" for k in range(len(docs.columns))]
    kept = docs.select(F.col("doc_id"), F.col("source"), word_count(docs[text]).cast("long").alias("size"),
                       *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    out = take(kept, plan).filter(F.col("copies") > 0)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
