"""Wavelet and nonlinear feature queries on epochs64."""

from __future__ import annotations

from neurotab import config
from neurotab import fixtures as fx
from neurotab.operators import nonlinear as nl
from neurotab.operators import wavelet as wv
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

K = ["epoch_id", "channel"]

_TAPS = "SELECT * FROM (VALUES " + ", ".join(
    f"({j}, {config.DB4_LOW[j]!r}, {config.DB4_HIGH[j]!r})" for j in range(8)) + ") AS t(j, lo, hi)"


def _dwt_level(src: str, n: int) -> str:
    n_out = (n + 7) // 2
    p = "(2 * o.range + 1 - t.j)"
    return f"""SELECT x.epoch_id, x.channel, o.range AS pos, sum(x.c * t.lo) AS a, sum(x.c * t.hi) AS d
FROM range(0, {n_out}) o CROSS JOIN taps t
JOIN {src} x ON x.pos = CASE WHEN {p} < 0 THEN -1 - {p} WHEN {p} >= {n} THEN 2 * {n} - 1 - {p} ELSE {p} END
GROUP BY 1, 2, 3"""


DWT_CTES = [
    ("taps", _TAPS),
    ("in0", "SELECT epoch_id, channel, sample_idx AS pos, value AS c FROM epochs64"),
    ("l1", _dwt_level("in0", 64)),
    ("in1", "SELECT epoch_id, channel, pos, a AS c FROM l1"),
    ("l2", _dwt_level("in1", 35)),
    ("in2", "SELECT epoch_id, channel, pos, a AS c FROM l2"),
    ("l3", _dwt_level("in2", 21)),
    ("coef", """SELECT epoch_id, channel, 'D1' AS band, pos, d AS coef FROM l1
UNION ALL SELECT epoch_id, channel, 'D2', pos, d FROM l2
UNION ALL SELECT epoch_id, channel, 'D3', pos, d FROM l3
UNION ALL SELECT epoch_id, channel, 'A3', pos, a FROM l3"""),
]


def _dwt(spark, sf_dir):
    return wv.dwt(fx.epochs64(spark, sf_dir), K, level=4)


@register("dwt_coeffs", sql(["epochs64"], "SELECT epoch_id, channel, band, CAST(pos AS BIGINT) AS pos, round(coef, 6) AS coef FROM coef",
                            DWT_CTES))
def q_dwt_coeffs(spark, sf_dir):
    return rounded(_dwt(spark, sf_dir))


@register("dwt_energy_entropy", sql(["epochs64"], """SELECT c.epoch_id, c.channel, c.band, round(sum(c.coef * c.coef), 6) AS dwt_energy,
       round(-sum(CASE WHEN abs(c.coef) > 0 THEN abs(c.coef) / s.s * log2(abs(c.coef) / s.s) END), 6) AS dwt_entropy
FROM coef c JOIN (SELECT epoch_id, channel, band, sum(abs(coef)) AS s FROM coef GROUP BY 1, 2, 3) s
  ON c.epoch_id = s.epoch_id AND c.channel = s.channel AND c.band = s.band
GROUP BY 1, 2, 3""", DWT_CTES))
def q_dwt_energy_entropy(spark, sf_dir):
    return rounded(wv.energy_entropy(_dwt(spark, sf_dir), K))


TPL_CTES = [
    ("sig", """SELECT epoch_id, channel, sample_idx AS i, value AS x,
       0.2 * stddev_pop(value) OVER (PARTITION BY epoch_id, channel) AS r,
       count(*) OVER (PARTITION BY epoch_id, channel) AS n FROM epochs64"""),
    ("tpl", """SELECT a.epoch_id, a.channel, a.i, a.r, a.n, a.x AS x0, b.x AS x1, c.x AS x2
FROM sig a JOIN sig b ON b.epoch_id = a.epoch_id AND b.channel = a.channel AND b.i = a.i + 1
LEFT JOIN sig c ON c.epoch_id = a.epoch_id AND c.channel = a.channel AND c.i = a.i + 2"""),
]

SAMPEN_BODY = """SELECT epoch_id, channel,
       round(CASE WHEN bb = 0 THEN 0.0 WHEN aa = 0 THEN 'inf'::DOUBLE ELSE -ln(aa / bb) END, 6) AS sample_entropy
FROM (SELECT p.epoch_id, p.channel,
             CAST(count_if(abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r) AS DOUBLE) AS bb,
             CAST(count_if(abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r AND abs(p.x2 - q.x2) <= p.r) AS DOUBLE) AS aa
      FROM tpl p JOIN tpl q ON p.epoch_id = q.epoch_id AND p.channel = q.channel AND p.i < q.i
      WHERE p.i <= p.n - 3 AND q.i <= q.n - 3 GROUP BY 1, 2)"""


@register("sample_entropy", sql(["epochs64"], SAMPEN_BODY, TPL_CTES))
def q_sample_entropy(spark, sf_dir):
    return rounded(nl.sample_entropy(fx.epochs64_arrays(spark, sf_dir), K))


APEN_BODY = """SELECT epoch_id, channel, round(avg(CASE WHEN m = 2 THEN ln(c / (n - 1.0)) END)
                                  - avg(CASE WHEN m = 3 THEN ln(c / (n - 2.0)) END), 6) AS approx_entropy
FROM (SELECT p.epoch_id, p.channel, p.i, p.n, 2 AS m,
             CAST(count_if(abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r) AS DOUBLE) AS c
      FROM tpl p JOIN tpl q ON p.epoch_id = q.epoch_id AND p.channel = q.channel GROUP BY 1, 2, 3, 4
      UNION ALL
      SELECT p.epoch_id, p.channel, p.i, p.n, 3 AS m,
             CAST(count_if(abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r AND abs(p.x2 - q.x2) <= p.r) AS DOUBLE) AS c
      FROM tpl p JOIN tpl q ON p.epoch_id = q.epoch_id AND p.channel = q.channel
      WHERE p.x2 IS NOT NULL AND q.x2 IS NOT NULL GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2"""


@register("approx_entropy", sql(["epochs64"], APEN_BODY, TPL_CTES))
def q_approx_entropy(spark, sf_dir):
    return rounded(nl.approx_entropy(fx.epochs64_arrays(spark, sf_dir), K))


PERM_BODY = """SELECT epoch_id, channel, round(-sum(p * log2(p)) / log2(6.0), 6) AS permutation_entropy
FROM (SELECT epoch_id, channel, pat, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY epoch_id, channel) AS p
      FROM (SELECT epoch_id, channel,
                   (CASE WHEN a <= b THEN 1 ELSE 0 END) + (CASE WHEN a <= c THEN 2 ELSE 0 END) + (CASE WHEN b <= c THEN 4 ELSE 0 END) AS pat
            FROM (SELECT epoch_id, channel, value AS a,
                         lead(value, 1) OVER (PARTITION BY epoch_id, channel ORDER BY sample_idx) AS b,
                         lead(value, 2) OVER (PARTITION BY epoch_id, channel ORDER BY sample_idx) AS c FROM epochs64)
            WHERE c IS NOT NULL)
      GROUP BY 1, 2, 3)
GROUP BY 1, 2"""


@register("permutation_entropy", sql(["epochs64"], PERM_BODY))
def q_permutation_entropy(spark, sf_dir):
    return rounded(nl.permutation_entropy(fx.epochs64(spark, sf_dir), K))


HIGUCHI_BODY = """SELECT epoch_id, channel, round(regr_slope(ln(lk), ln(1.0 / k)), 6) AS higuchi_fd
FROM (SELECT epoch_id, channel, k, sum(ll / k * (n - 1) / (k * nmax)) / k AS lk
      FROM (SELECT a.epoch_id, a.channel, k.range AS k, a.i % k.range AS m, a.n,
                   floor((a.n - a.i % k.range - 1) / k.range) AS nmax, sum(abs(a.x - b.x)) AS ll
            FROM sig a CROSS JOIN range(1, 11) k
            JOIN sig b ON b.epoch_id = a.epoch_id AND b.channel = a.channel AND b.i = a.i - k.range
            WHERE floor(a.i / k.range) >= 1 AND floor(a.i / k.range) <= floor((a.n - a.i % k.range - 1) / k.range) - 1
            GROUP BY 1, 2, 3, 4, 5, 6)
      GROUP BY 1, 2, 3)
GROUP BY 1, 2"""


@register("higuchi_fd", sql(["epochs64"], HIGUCHI_BODY, TPL_CTES[:1]))
def q_higuchi_fd(spark, sf_dir):
    return rounded(nl.higuchi_fd(fx.epochs64(spark, sf_dir), K))


DFA_CTES = [
    ("prof", """SELECT epoch_id, channel, sample_idx AS i, n,
       sum(xc) OVER (PARTITION BY epoch_id, channel ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
FROM (SELECT *, value - avg(value) OVER (PARTITION BY epoch_id, channel) AS xc,
             count(*) OVER (PARTITION BY epoch_id, channel) AS n FROM epochs64)"""),
    ("sizes", """SELECT DISTINCT n, CAST(floor(4 * pow(1.2, r.range)) AS BIGINT) AS s
FROM (SELECT DISTINCT n FROM prof) p CROSS JOIN range(0, 200) r
WHERE r.range <= floor(ln(0.1 * n / 4) / ln(1.2))"""),
    ("box", """SELECT p.epoch_id, p.channel, z.s, floor(p.i / z.s) AS b,
       greatest(regr_syy(p.y, CAST(p.i % z.s AS DOUBLE)) - regr_sxy(p.y, CAST(p.i % z.s AS DOUBLE)) ^ 2
                / regr_sxx(p.y, CAST(p.i % z.s AS DOUBLE)), 0.0) AS rss
FROM prof p JOIN sizes z ON z.n = p.n WHERE p.i < p.n - p.n % z.s GROUP BY 1, 2, 3, 4"""),
]

DFA_BODY = """SELECT epoch_id, channel, round(regr_slope(ln(f), ln(CAST(s AS DOUBLE))), 6) AS dfa
FROM (SELECT epoch_id, channel, s, sqrt(avg(rss / s)) AS f FROM box GROUP BY 1, 2, 3) WHERE f > 0 GROUP BY 1, 2"""


@register("dfa_exponent", sql(["epochs64"], DFA_BODY, DFA_CTES))
def q_dfa_exponent(spark, sf_dir):
    return rounded(nl.dfa_exponent(fx.epochs64(spark, sf_dir), K))
