"""The signal kernels exposed to SQL users.

``register_sql_functions(spark)`` adds, for a sampling rate (default 128 Hz):

* ``welch_psd(values)``: one-sided Welch density, array<double>
* ``bandpass_filter(values)`` / ``notch_filter(values)``: zero-phase IIR filters
* ``resample_to_target(values)``: Fourier resampling from ``source_rate`` to the target rate
* ``sample_entropy(values)`` / ``approx_entropy(values)``
* table function ``epochs(values, size)``: (epoch_id, values), non-overlapping,
  tail dropped, or one zero-padded epoch when shorter than ``size``
"""

from pyspark.sql.functions import udtf

from neurotab import config
from neurotab.functions import iir
from neurotab.functions.kernels import (approx_entropy_udf, resample_udf, sample_entropy_udf, welch_udf,
                                        zero_phase_udf)


@udtf(returnType="epoch_id: int, values: array<double>", useArrow=True)
class Epochs:
    def eval(self, values, size: int):
        vals = list(values or [])
        n = len(vals)
        if n < size:
            yield 0, vals + [0.0] * (size - n)
            return
        for i in range(n // size):
            yield i, vals[i * size:(i + 1) * size]


def register_sql_functions(spark, fs: float = config.SAMPLING_RATE, source_rate: float = 256.0) -> None:
    band = iir.bandpass_sections(config.BANDPASS_LOW, config.BANDPASS_HIGH, fs, config.FILTER_ORDER)
    spark.udf.register("welch_psd", welch_udf(float(fs), config.WELCH_NPERSEG))
    spark.udf.register("bandpass_filter", zero_phase_udf(band))
    spark.udf.register("notch_filter", zero_phase_udf([iir.notch(config.NOTCH_FREQ, config.NOTCH_Q, fs)]))
    spark.udf.register("resample_to_target", resample_udf(float(source_rate), float(fs)))
    spark.udf.register("sample_entropy", sample_entropy_udf())
    spark.udf.register("approx_entropy", approx_entropy_udf())
    spark.udtf.register("epochs", Epochs)
