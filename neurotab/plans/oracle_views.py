"""DuckDB texts of the fixture views, used to build oracle SQL strings.

The oracle runs on DuckDB with the driver's tables registered as views; each
oracle query is one statement: ``WITH <fixture views>, <own CTEs> SELECT ...``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "samples": """SELECT user_id AS recording_id, event_type AS channel,
       CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_idx, value
FROM events""",
    "samples_big": """SELECT l_suppkey AS recording_id, l_returnflag AS channel,
       CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS sample_idx,
       l_extendedprice / 1000 AS value
FROM lineitem""",
    "epochs64": """SELECT CAST(floor(vec_id / 2) AS BIGINT) AS epoch_id,
       CASE WHEN vec_id % 2 = 0 THEN 'F3' ELSE 'F4' END AS channel,
       CAST(pos AS BIGINT) AS sample_idx, CAST(x AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, 63)) AS pos FROM embeddings)""",
    "feat": """SELECT vec_id AS id, vec_id % 23 AS subject_id, label % 3 AS label, CAST(pos AS INT) AS feature,
       CAST(x AS DOUBLE) AS value
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(0, 63)) AS pos FROM embeddings)""",
    "pred": """SELECT id, m AS model, y_true, s0, s1, s2,
       CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS y_pred,
       exp(s0)/(exp(s0)+exp(s1)+exp(s2)) AS p0, exp(s1)/(exp(s0)+exp(s1)+exp(s2)) AS p1,
       exp(s2)/(exp(s0)+exp(s1)+exp(s2)) AS p2
FROM (SELECT vec_id AS id, m, label % 3 AS y_true, coalesce(CAST(list_extract(embedding, 3*m+1) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+16) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+31) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+46) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+61) AS DOUBLE), 0.0) AS s0,
             coalesce(CAST(list_extract(embedding, 3*m+2) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+17) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+32) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+47) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+62) AS DOUBLE), 0.0) AS s1,
             coalesce(CAST(list_extract(embedding, 3*m+3) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+18) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+33) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+48) AS DOUBLE), 0.0) + coalesce(CAST(list_extract(embedding, 3*m+63) AS DOUBLE), 0.0) AS s2
      FROM embeddings CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS v(m))""",
    "ratings": """SELECT c_custkey AS trial_id, c_custkey % 23 AS subject_id,
       CASE c_custkey % 3 WHEN 0 THEN 'DEAP' WHEN 1 THEN 'DREAMER' ELSE 'MAHNOB' END AS dataset,
       CAST(1 + (c_custkey * 7) % (CASE WHEN c_custkey % 3 = 1 THEN 5 ELSE 9 END) AS DOUBLE) AS valence,
       CAST(1 + c_nationkey % (CASE WHEN c_custkey % 3 = 1 THEN 5 ELSE 9 END) AS DOUBLE) AS arousal
FROM customer""",
    "history": """SELECT o_orderpriority AS run_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS epoch,
       round(avg(o_totalprice) / 100000, 6) AS val_loss, count(*) AS n
FROM orders GROUP BY 1, 2""",
    "job_events": """SELECT o_custkey AS job_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS epoch,
       count(*) OVER (PARTITION BY o_custkey) AS total_epochs, o_totalprice AS loss
FROM orders""",
    "sessions": """SELECT concat('/data/Part', CAST(s_suppkey AS VARCHAR), '_s', CAST(s_nationkey AS VARCHAR), '/rec',
              CASE k WHEN 0 THEN '.bdf' WHEN 1 THEN '.XML' ELSE '.txt' END) AS path, k
FROM supplier CROSS JOIN (VALUES (0),(1),(2)) AS v(k) WHERE NOT (k = 1 AND s_suppkey % 5 = 0)""",
    "xml_docs": """SELECT c_custkey AS session_id,
       concat('<session><feltArsl>', CAST(1 + c_nationkey % 9 AS VARCHAR), '</feltArsl>',
              CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('<feltVlnc>', CAST(1 + c_custkey % 9 AS VARCHAR), '</feltVlnc>') END,
              '</session>') AS xml
FROM customer""",
    "folds": """SELECT id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INT) AS fold
FROM (SELECT vec_id AS id, label % 3 AS label FROM embeddings)""",
    "bands": """SELECT * FROM (VALUES ('delta', 0.5, 4.0, 0), ('theta', 4.0, 8.0, 1), ('alpha', 8.0, 13.0, 2),
       ('beta', 13.0, 30.0, 3), ('gamma', 30.0, 45.0, 4)) AS t(band, low, high, band_ord)""",
    "frontal_pairs": """SELECT * FROM (VALUES ('F3', 'F4', 0), ('Fp1', 'Fp2', 1), ('AF3', 'AF4', 2)) AS t(left_ch, right_ch, pair_ord)""",
    "levels": """SELECT * FROM (VALUES (0, 'Low'), (1, 'Moderate'), (2, 'High')) AS t(label, level)""",
    # periodic-Hann Welch PSD of epochs64 by an explicit DFT (64 samples, one segment, 33 bins)
    "psd64": """SELECT epoch_id, channel, CAST(k * 2.0 AS DOUBLE) AS freq,
       (re * re + im * im) / (128.0 * 24.0) * CASE WHEN k IN (0, 32) THEN 1.0 ELSE 2.0 END AS power
FROM (SELECT s.epoch_id, s.channel, b.k,
             sum(s.xc * (0.5 - 0.5 * cos(2 * pi() * s.sample_idx / 64.0)) * cos(2 * pi() * b.k * s.sample_idx / 64.0)) AS re,
             sum(s.xc * (0.5 - 0.5 * cos(2 * pi() * s.sample_idx / 64.0)) * sin(2 * pi() * b.k * s.sample_idx / 64.0)) AS im
      FROM (SELECT epoch_id, channel, sample_idx, value - avg(value) OVER (PARTITION BY epoch_id, channel) AS xc
            FROM epochs64) s
      CROSS JOIN (SELECT CAST(range AS BIGINT) AS k FROM range(0, 33)) b
      GROUP BY 1, 2, 3)""",
}

# views that read other views
DEPENDS = {"psd64": ["epochs64"], "folds": []}


def sql(views: list[str], body: str, ctes: list[tuple[str, str]] | None = None, given: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixture views (and their dependencies), then extra CTEs,
    then ``body``.  ``given`` CTEs come first (they may be recursive) and stand in
    for the views of their names."""
    ordered: list[str] = []
    there = {n for n, _ in given or []}

    def add(v: str) -> None:
        if v in there:
            return
        for d in DEPENDS.get(v, []):
            add(d)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    parts = [f"{n} AS ({t})" for n, t in (given or [])]
    parts += [f"{v} AS ({VIEWS[v]})" for v in ordered]
    parts += [f"{n} AS ({t})" for n, t in (ctes or [])]
    return (("WITH RECURSIVE " if given else "WITH ") + ",\n".join(parts) + "\n" if parts else "") + body
