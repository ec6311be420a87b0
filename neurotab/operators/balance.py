"""Class balancing by synthetic minority oversampling (SMOTE).

Every class except the largest is raised to the largest class's count.  A
synthetic row is base + u * (neighbour - base), with the neighbour one of the
base's k nearest same-class rows (exact kNN join, partitioned by class).
Randomness is replaced by md5 of (seed, class, synthetic index), so results
are repeatable and identical on any cluster.  Synthetic rows are spread over
the base rows round-robin, so no task generates a whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.operators.knn import knn_join
from neurotab.operators.ordering import sequence_index


def _md5_int(parts, start: int) -> F.Column:
    h = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def smote_neighbour_k(class_counts: list[int]) -> int:
    smallest = min(class_counts)
    return 1 if smallest <= 1 else min(5, smallest - 1)


def smote(df: DataFrame, id_col: str = "id", label: str = "label", vec: str = "features",
          seed: int = config.SEED) -> DataFrame:
    """Originals (is_synthetic false) plus synthetic rows.
    Output: (label, is_synthetic, src_id, syn_idx, features)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}   # one row per class
    k = smote_neighbour_k(list(counts.values()))
    target = max(counts.values())
    spark = df.sparkSession
    need = spark.createDataFrame([(c, int(n), int(target - n)) for c, n in counts.items()],
                                 f"{label} int, _nc long, _new long")
    numbered = sequence_index(df.select(id_col, label), [label], [id_col], name="_pos")
    base = numbered.join(F.broadcast(need), label).where(F.col("_pos") < F.col("_new"))
    copies = F.ceil((F.col("_new") - F.col("_pos")) / F.col("_nc")).cast("int")
    syn = base.select(id_col, label, "_nc", "_pos", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_t")) \
        .select(id_col, label, (F.col("_pos") + F.col("_t") * F.col("_nc")).alias("syn_idx"))
    key = [F.lit(seed), F.col(label), F.col("syn_idx")]
    syn = syn.select(id_col, label, "syn_idx", (1 + _md5_int(key, 1) % k).cast("int").alias("_nn"),
                     (_md5_int(key, 9) / F.lit(4294967296.0)).alias("_u"))
    # neighbours are asked only for rows that get a copy; the largest class needs none
    rows = df.select(id_col, label, vec)
    asked = rows.join(base.select(id_col), id_col, "left_semi")
    nn = knn_join(asked, rows, k, id_col, vec, partition=[label], exclude_self=True)
    syn = syn.join(nn.select(F.col("q_id").alias(id_col), F.col("rank").alias("_nn"), "p_id"), [id_col, "_nn"])
    x = df.select(F.col(id_col), F.col(vec).alias("_x"))
    y = df.select(F.col(id_col).alias("p_id"), F.col(vec).alias("_y"))
    syn = syn.join(x, id_col).join(y, "p_id")
    new = F.zip_with("_x", "_y", lambda a, b: a + F.col("_u") * (b - a))
    synthetic = syn.select(label, F.lit(True).alias("is_synthetic"), F.col(id_col).alias("src_id"),
                           F.col("syn_idx").cast("long").alias("syn_idx"), new.alias(vec))
    originals = df.select(label, F.lit(False).alias("is_synthetic"), F.col(id_col).alias("src_id"),
                          F.lit(None).cast("long").alias("syn_idx"), vec)
    return originals.unionByName(synthetic)
