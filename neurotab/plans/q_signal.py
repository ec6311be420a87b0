"""Cleaning, epoching and resampling queries (samples: epoch 4, baseline 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.functions import iir
from neurotab.operators import preprocess as pp
from neurotab.operators.blockfft import resample
from neurotab.operators.blockfilter import zero_phase
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

REC = ["recording_id"]
SIG = ["recording_id", "channel"]


@register("car_reference", sql(["samples"], """SELECT recording_id, channel, sample_idx,
       round(value - avg(value) OVER (PARTITION BY recording_id, sample_idx), 6) AS value FROM samples"""))
def q_car(spark, sf_dir):
    return rounded(pp.car_reference(fx.samples(spark, sf_dir), REC))


@register("baseline_correct", sql(["samples"], """SELECT recording_id, channel, sample_idx,
       round(value - coalesce(avg(CASE WHEN sample_idx < 3 THEN value END) OVER (PARTITION BY recording_id, channel), 0), 6)
       AS value FROM samples"""))
def q_baseline(spark, sf_dir):
    return rounded(pp.baseline_correct(fx.samples(spark, sf_dir), SIG, baseline=3))


ZSCORE_BODY = """SELECT recording_id, channel, sample_idx,
       round(CASE WHEN sd > 1e-10 THEN (value - mu) / sd ELSE value - mu END, 6) AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY recording_id, channel) AS mu,
             stddev_pop(value) OVER (PARTITION BY recording_id, channel) AS sd FROM samples)"""


@register("zscore", sql(["samples"], ZSCORE_BODY))
def q_zscore(spark, sf_dir):
    return rounded(pp.zscore(fx.samples(spark, sf_dir), SIG))


EPOCH_BODY = """SELECT s.recording_id, s.channel, CAST(floor(s.sample_idx / 4) AS BIGINT) AS epoch_id,
       CAST(s.sample_idx % 4 AS BIGINT) AS pos, round(s.value, 6) AS value
FROM src s JOIN cnt c ON s.recording_id = c.recording_id AND s.channel = c.channel
WHERE c.n < 4 OR floor(s.sample_idx / 4) < floor(c.n / 4)
UNION ALL
SELECT c.recording_id, c.channel, CAST(0 AS BIGINT) AS epoch_id, CAST(p.range AS BIGINT) AS pos, 0.0 AS value
FROM cnt c JOIN range(0, 4) p ON p.range >= c.n WHERE c.n < 4"""


@register("epoching", sql(["samples"], EPOCH_BODY, [("src", "SELECT * FROM samples"),
                                                     ("cnt", "SELECT recording_id, channel, count(*) AS n FROM samples GROUP BY 1, 2")]))
def q_epoching(spark, sf_dir):
    return rounded(pp.epoching(fx.samples(spark, sf_dir), SIG, size=4))


ARTIFACT_BODY = """SELECT recording_id, channel, round(variance, 6) AS variance,
       (exceed AND row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN exceed THEN 0 ELSE 1 END, channel) <= 3) AS flagged
FROM (SELECT *, variance > avg(variance) OVER (PARTITION BY recording_id) + 1.0 * stddev_pop(variance) OVER (PARTITION BY recording_id)
               AND count(*) OVER (PARTITION BY recording_id) >= 5 AS exceed
      FROM (SELECT recording_id, channel, var_pop(value) AS variance FROM samples GROUP BY 1, 2))"""


@register("artifact_flag", sql(["samples"], ARTIFACT_BODY))
def q_artifact(spark, sf_dir):
    # fixture scaling: 5 channels per recording cannot exceed mean + 2 sd, so 1 sd and >= 5 channels
    return rounded(pp.artifact_flags(fx.samples(spark, sf_dir), REC, n_std=1.0, min_channels=5))


@register("moving_average", sql(["samples"], """SELECT recording_id, channel, sample_idx, round(value, 6) AS value,
       round(avg(value) OVER (PARTITION BY recording_id, channel ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
       AS moving_avg FROM samples"""))
def q_moving_average(spark, sf_dir):
    # small blocks so that the block halo is exercised on the fixture
    return rounded(pp.moving_average(fx.samples(spark, sf_dir), SIG, k=3, block=8))


PREVIEW_BODY = """SELECT recording_id, sample_idx, round(sample_idx / 32.0, 3) AS time,
       coalesce(max(CASE WHEN channel = 'A' THEN value END), 0.0) AS A,
       coalesce(max(CASE WHEN channel = 'N' THEN value END), 0.0) AS N,
       coalesce(max(CASE WHEN channel = 'R' THEN value END), 0.0) AS R
FROM (SELECT s.*, greatest(1, CAST(floor(m.n / 50) AS BIGINT)) AS step
      FROM samples_big s JOIN (SELECT recording_id, max(c) AS n FROM
                               (SELECT recording_id, channel, count(*) AS c FROM samples_big GROUP BY 1, 2) GROUP BY 1) m
        ON s.recording_id = m.recording_id)
WHERE sample_idx < 32 * 5 AND sample_idx % step = 0
GROUP BY 1, 2"""


@register("waveform_preview", sql(["samples_big"], PREVIEW_BODY))
def q_waveform_preview(spark, sf_dir):
    from neurotab.operators.views import waveform_preview
    return waveform_preview(fx.samples_big(spark, sf_dir), REC, ["A", "N", "R"], sr=32, seconds=5, max_points=50)


RESAMPLE_BODY = """SELECT epoch_id, channel, CAST(t.range AS BIGINT) AS sample_idx,
       round(0.5 / 32.0 * sum(CASE WHEN k = 0 THEN re WHEN k = 16 THEN 2 * re * cos(pi() * t.range)
                                   ELSE 2 * (re * cos(2 * pi() * k * t.range / 32.0) - im * sin(2 * pi() * k * t.range / 32.0)) END), 6) AS value
FROM spec CROSS JOIN range(0, 32) t GROUP BY 1, 2, 3"""
SPEC = """SELECT epoch_id, channel, b.range AS k,
       sum(value * cos(2 * pi() * b.range * sample_idx / 64.0)) AS re,
       -sum(value * sin(2 * pi() * b.range * sample_idx / 64.0)) AS im
FROM epochs64 CROSS JOIN range(0, 17) b GROUP BY 1, 2, 3"""


@register("fourier_resample", sql(["epochs64"], RESAMPLE_BODY, [("spec", SPEC)]))
def q_fourier_resample(spark, sf_dir):
    """64 to 32 samples, by transforms of arrays of at most 8 (8 x 8 and 4 x 8)."""
    return rounded(resample(fx.epochs64(spark, sf_dir), ["epoch_id", "channel"], 128, 64, longest=8))


def cascade_cte(sections, name: str, srcn: str, keys: tuple[str, str]) -> str:
    """Text of a recursive CTE ``name``: the sections run over (keys..., j, nn, e)
    of ``srcn`` in the order of j, from the steady state of the first e."""
    from neurotab.functions.kernels import cascade_zi
    num = lambda v: repr(float(v))
    n, Z = len(sections), [num(v) for v in cascade_zi(sections)]
    k1, k2 = keys

    def cascade(rows: str) -> str:
        """``rows`` has v0 and the states s0..; one subquery a section adds its output."""
        for i, (b, _) in enumerate(sections):
            rows = f"SELECT *, {num(b[0])} * v{i} + s{2 * i} AS v{i + 1} FROM ({rows})"
        states = ", ".join(
            f"({num(b[1])} * v{i} + s{2 * i + 1}) - {num(a[1])} * v{i + 1} AS s{2 * i}, {num(b[2])} * v{i} - {num(a[2])} * v{i + 1} AS s{2 * i + 1}"
            for i, (b, a) in enumerate(sections))
        return f"SELECT {k1}, {k2}, j, nn, v{n} AS y, {states} FROM ({rows})"

    first = ", ".join(f"{z} * e AS s{i}" for i, z in enumerate(Z))
    carried = ", ".join(f"f.s{i}" for i in range(2 * n))
    return cascade(f"SELECT {k1}, {k2}, j, nn, e AS v0, {first} FROM {srcn} WHERE j = 0") + "\nUNION ALL\n" + cascade(
        f"SELECT f.{k1}, f.{k2}, f.j + 1 AS j, f.nn, x.e AS v0, {carried} FROM {name} f JOIN {srcn} x ON x.{k1} = f.{k1} AND x.{k2} = f.{k2} AND x.j = f.j + 1")


def filtfilt_ctes(sections, src: str, keys: tuple[str, str], prefix: str) -> list[tuple[str, str]]:
    """DuckDB CTEs running a forward-backward cascade of second-order sections
    over every signal of ``src`` (keys..., sample_idx, value) of any length: odd
    extension, steady-state initial conditions, transposed direct form with the
    kernel's association; signals no longer than the padding pass through.  The
    last CTE, ``{prefix}out``, has the same columns as ``src``.  (Recursive: the
    statement must start WITH RECURSIVE.)"""
    from neurotab.functions.kernels import padding
    pad = padding(sections)
    k1, k2 = keys
    rec = lambda name, srcn: (name, cascade_cte(sections, name, srcn, keys))

    p = prefix
    return [
        (f"{p}n", f"SELECT {k1}, {k2}, count(*) AS n FROM {src} GROUP BY 1, 2"),
        (f"{p}ext", f"""SELECT s.{k1}, s.{k2}, s.sample_idx + {pad} AS j, c.n + {2 * pad} AS nn, s.value AS e
FROM {src} s JOIN {p}n c ON c.{k1} = s.{k1} AND c.{k2} = s.{k2} WHERE c.n > {pad}
UNION ALL
SELECT s.{k1}, s.{k2}, {pad} - m.sample_idx, c.n + {2 * pad}, 2 * s.value - m.value
FROM {src} s JOIN {src} m ON m.{k1} = s.{k1} AND m.{k2} = s.{k2} JOIN {p}n c ON c.{k1} = s.{k1} AND c.{k2} = s.{k2}
WHERE c.n > {pad} AND s.sample_idx = 0 AND m.sample_idx BETWEEN 1 AND {pad}
UNION ALL
SELECT s.{k1}, s.{k2}, {pad} + 2 * (c.n - 1) - m.sample_idx, c.n + {2 * pad}, 2 * s.value - m.value
FROM {src} s JOIN {src} m ON m.{k1} = s.{k1} AND m.{k2} = s.{k2} JOIN {p}n c ON c.{k1} = s.{k1} AND c.{k2} = s.{k2}
WHERE c.n > {pad} AND s.sample_idx = c.n - 1 AND m.sample_idx BETWEEN c.n - 1 - {pad} AND c.n - 2"""),
        rec(f"{p}fwd", f"{p}ext"),
        (f"{p}rev", f"SELECT {k1}, {k2}, nn - 1 - j AS j, nn, y AS e FROM {p}fwd"),
        rec(f"{p}bwd", f"{p}rev"),
        (f"{p}out", f"""SELECT {k1}, {k2}, CAST(nn - 1 - j - {pad} AS BIGINT) AS sample_idx, y AS value
FROM {p}bwd WHERE nn - 1 - j - {pad} BETWEEN 0 AND nn - {2 * pad} - 1
UNION ALL
SELECT s.{k1}, s.{k2}, s.sample_idx, s.value FROM {src} s JOIN {p}n c ON c.{k1} = s.{k1} AND c.{k2} = s.{k2}
WHERE c.n <= {pad}"""),
    ]


def _filtfilt_oracle(sections) -> str:
    from neurotab.plans.oracle_views import VIEWS
    ctes = [("epochs64", VIEWS["epochs64"])] + filtfilt_ctes(sections, "epochs64", ("epoch_id", "channel"), "f_")
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in ctes) + \
        "\nSELECT epoch_id, channel, sample_idx, round(value, 6) AS value FROM f_out"


def _notch_oracle() -> str:
    return _filtfilt_oracle([iir.notch(50.0, 30.0, 128.0)])


def _bandpass_oracle() -> str:
    return _filtfilt_oracle(iir.bandpass_sections(0.5, 45.0, 128.0, 5))


@register("bandpass", _bandpass_oracle())
def q_bandpass(spark, sf_dir):
    band, _ = pp.cleaning_filters(128.0)
    return rounded(zero_phase(fx.epochs64(spark, sf_dir), ["epoch_id", "channel"], [band]))


@register("notch", _notch_oracle())
def q_notch(spark, sf_dir):
    """64 samples a signal, in blocks of 10 (the last one takes the rest)."""
    _, notch = pp.cleaning_filters(128.0)
    return rounded(zero_phase(fx.epochs64(spark, sf_dir), ["epoch_id", "channel"], [notch], block=10))


CHAIN_CTES = [
    ("car", "SELECT recording_id, channel, sample_idx, value - avg(value) OVER (PARTITION BY recording_id, sample_idx) AS value FROM samples"),
    ("base", """SELECT recording_id, channel, sample_idx,
       value - coalesce(avg(CASE WHEN sample_idx < 3 THEN value END) OVER (PARTITION BY recording_id, channel), 0) AS value FROM car"""),
    ("src", """SELECT recording_id, channel, sample_idx,
       CASE WHEN sd > 1e-10 THEN (value - mu) / sd ELSE value - mu END AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY recording_id, channel) AS mu,
             stddev_pop(value) OVER (PARTITION BY recording_id, channel) AS sd FROM base)"""),
    ("cnt", "SELECT recording_id, channel, count(*) AS n FROM src GROUP BY 1, 2"),
]


@register("clean_chain", sql(["samples"], EPOCH_BODY, CHAIN_CTES))
def q_clean_chain(spark, sf_dir):
    """CAR -> baseline -> z-score -> epochs on samples (no IIR steps: signals are
    shorter than the filters' padding; artifact step skipped below 20 channels)."""
    return rounded(pp.clean(fx.samples(spark, sf_dir), REC, filters=False, baseline=3, epoch_size=4))


def _clean_full_oracle() -> str:
    from neurotab.plans.oracle_views import VIEWS
    keys = ("recording_id", "channel")
    ctes = [("samples_big", VIEWS["samples_big"])]
    ctes += filtfilt_ctes(iir.bandpass_sections(0.5, 45.0, 128.0, 5), "samples_big", keys, "bp_")
    ctes += filtfilt_ctes([iir.notch(50.0, 30.0, 128.0)], "bp_out", keys, "nt_")
    ctes += [
        ("car", "SELECT recording_id, channel, sample_idx, value - avg(value) OVER (PARTITION BY recording_id, sample_idx) AS value FROM nt_out"),
        ("base", """SELECT recording_id, channel, sample_idx,
       value - coalesce(avg(CASE WHEN sample_idx < 24 THEN value END) OVER (PARTITION BY recording_id, channel), 0) AS value FROM car"""),
        ("src", """SELECT recording_id, channel, sample_idx,
       CASE WHEN sd > 1e-10 THEN (value - mu) / sd ELSE value - mu END AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY recording_id, channel) AS mu,
             stddev_pop(value) OVER (PARTITION BY recording_id, channel) AS sd FROM base)"""),
        ("cnt", "SELECT recording_id, channel, count(*) AS n FROM src GROUP BY 1, 2"),
    ]
    body = """SELECT s.recording_id, s.channel, CAST(floor(s.sample_idx / 32) AS BIGINT) AS epoch_id,
       CAST(s.sample_idx % 32 AS BIGINT) AS pos, round(s.value, 6) AS value
FROM src s JOIN cnt c ON s.recording_id = c.recording_id AND s.channel = c.channel
WHERE c.n < 32 OR floor(s.sample_idx / 32) < floor(c.n / 32)"""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in ctes) + "\n" + body


@register("clean_full", _clean_full_oracle())
def q_clean_full(spark, sf_dir):
    """Full chain with band-pass and notch on samples_big (162-235 samples per signal)."""
    return rounded(pp.clean(fx.samples_big(spark, sf_dir), REC, filters=True, baseline=24, epoch_size=32))


def _blocks_oracle() -> str:
    from neurotab.plans.oracle_views import VIEWS
    ctes = [("samples_big", VIEWS["samples_big"]), *filtfilt_ctes(iir.bandpass_sections(0.5, 45.0, 128.0, 5), "samples_big", ("recording_id", "channel"), "bp_")]
    return sql([], "SELECT recording_id, channel, sample_idx, round(value, 6) AS value FROM bp_out", given=ctes)


@register("zero_phase_blocks", _blocks_oracle())
def q_zero_phase_blocks(spark, sf_dir):
    """Band-pass of samples_big in blocks of 48 (three to four a signal, states
    composed in groups of two)."""
    band, _ = pp.cleaning_filters(128.0)
    return rounded(zero_phase(fx.samples_big(spark, sf_dir), SIG, [band], block=48, fan=2))
