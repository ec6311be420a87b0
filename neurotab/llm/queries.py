"""Registered queries of the text operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


@register("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.quality import assess

    out = assess(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "n_lost_words", "kept")


# the water level is the one that Spark finds: the first source, by cap / weight, that stays under its cap
OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM src),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (source_size * 2)::DOUBLE AS cap FROM named),
levelled AS (
  SELECT *, ((sum(source_size) OVER () * 150)::DOUBLE / 100
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
final AS (SELECT lvl FROM levelled WHERE lvl * weight <= cap ORDER BY cap / weight, i LIMIT 1),
targets AS (
  SELECT source, source_size, round(least(cap, coalesce((SELECT lvl FROM final) * weight, cap)), 6) AS target FROM levelled),
ratios AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS r,
         (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(r) AS whole, CASE WHEN size > 0 AND r > floor(r) THEN u / (1.0::DOUBLE - u) * (1.0::DOUBLE - (r - floor(r))) / (r - floor(r)) END AS q
  FROM ratios),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY floor(q / (1.0::DOUBLE + q) * 16384), q, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked WHERE q IS NOT NULL
  UNION ALL SELECT *, NULL FROM ranked WHERE q IS NULL)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN size = 0 THEN 0 ELSE whole + CASE
         WHEN q IS NOT NULL AND before * 2 + size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM summed
"""


@register("op8_mixing", OP8_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@register("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "accepted")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op2_topk_search", OP2_SQL)
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


OP4_SQL = """
WITH r AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM r WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r LEFT JOIN f USING (payload_digest)
"""


@register("op4_warc", OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.warc import read_archives, write_archives
    from neurotab.session import scratch_path

    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.kneser_ney import fit, held_out, score

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, fit(docs.filter(~held_out(F.col("doc_id")))))
    return out.withColumn("held_out", held_out(F.col("doc_id")))


@register("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.sentencepiece import tokenize

    return tokenize(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_tokens", "round_trip", "ids")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ip AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM ip),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
found AS (SELECT r, s, dp.n, item FROM (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM dp) dp JOIN iw ON dp.win = iw.win AND dp.n = iw.n),
spans AS (SELECT DISTINCT r, s, n FROM found),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM spans) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


@register("op12_decontamination", OP12_SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.whitening import fit, identity_error, whiten

    model = fit(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return whiten(model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(identity_error(model)).alias("identity_error"))


def _op11_sql(rounds: int = 5, k: int = 40, d: int = 64) -> str:
    """Whole-number Lloyd rounds in long form, one group of CTEs a round."""
    steps = [f"""
x0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
       WHERE embedding IS NOT NULL AND len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, x FROM x0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM v QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (SELECT r, min(c) AS c, min(dist) AS dist FROM (
           SELECT r, c, dist, min(dist) OVER (PARTITION BY r) AS best FROM (
             SELECT r, c, CAST(list_sum(list_transform(list_zip(v.x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM v, c{n}))
         WHERE dist = best GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{n}.c, v.x, unnest(range(1, {d + 1})) AS i FROM a{n} JOIN v USING (r)) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
"""


OP11_SQL = _op11_sql()


@register("op11_centroid_clustering", OP11_SQL)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.vafile import cluster

    return cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))[0]
