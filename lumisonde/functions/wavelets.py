"""Wavelet pyramids of array columns: each level halves the row's array, so a clip stays one row.

Filters are orthonormal taps used with periodic ends: details and approximations together have
the energy of the signal, and ``restored`` gives it back. An odd length is continued by its last value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a

HAAR = (1 / math.sqrt(2), 1 / math.sqrt(2))
_R = math.sqrt(3)
DB2 = tuple(v / (4 * math.sqrt(2)) for v in (1 + _R, 3 + _R, 3 - _R, 1 - _R))
#: Daubechies' filter of eight taps. Fixed values.
DB4 = (0.2303778133088965, 0.7148465705529156, 0.6308807679298589, -0.0279837694168599, -0.1870348117190931, 0.0308413818355607, 0.0328830116668852, -0.0105974017850690)


def mirrored(taps: Sequence[float]) -> list[float]:
    """The taps of the details."""
    return [(-1) ** k * v for k, v in enumerate(reversed(taps))]


def _filtered(x: str, taps: Sequence[float]) -> Column:
    n = F.size(x)
    at = lambda k, j: F.get(x, ((2 * k + j) % n).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: sum((h * at(k, j) for j, h in enumerate(taps)), F.lit(0.0))))


def pyramid(clips: DataFrame, x: str, levels: int, taps: Sequence[float] = DB4) -> DataFrame:
    """clips with details d1 (finest) to d<levels> and the last approximation, approx; a level below which less than two values are left is null."""
    out = clips.withColumn("approx", F.col(x))
    for k in range(1, levels + 1):
        even = F.when(F.size("approx") % 2 == 1, F.concat("approx", F.slice("approx", -1, 1))).otherwise(F.col("approx"))
        out = out.withColumn("even_", F.when(F.size("approx") >= 2, even))
        out = out.withColumns({f"d{k}": _filtered("even_", mirrored(taps)), "approx": F.when(F.col("even_").isNull(), F.col("approx")).otherwise(_filtered("even_", taps))}).drop("even_")
    return out


def _spread(approx: str, detail: str, taps: Sequence[float]) -> Column:
    """What a level and its details come from: value i gets share j of place k for each 2k + j = i around the ends."""
    n, high, half = 2 * F.size(approx), mirrored(taps), F.size(approx)
    place = lambda i, j: (F.floor(F.pmod(i - j, n) / 2)).cast("int")
    share = lambda i, j: F.when(F.pmod(i - j, F.lit(2)) == 0, taps[j] * F.get(approx, place(i, j)) + high[j] * F.get(detail, place(i, j))).otherwise(0.0)
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((share(i, j) for j in range(len(taps))), F.lit(0.0))))


def restored(levels: DataFrame, count: int, taps: Sequence[float] = DB4, into: str = "restored") -> DataFrame:
    """levels with the signal that a pyramid's arrays come from; an odd length has its continuation at the end."""
    out = levels.withColumn(into, F.col("approx"))
    for k in range(count, 0, -1):
        cut = F.slice(into, F.lit(1), F.size(f"d{k}"))
        out = out.withColumn("low_", cut).withColumn(into, F.when(F.col(f"d{k}").isNull(), F.col(into)).otherwise(_spread("low_", f"d{k}", taps))).drop("low_")
    return out


def energies(levels: DataFrame, count: int) -> dict[str, Column]:
    """For each array of a pyramid its share of the energy, and the entropy of its values' shares in bits."""
    names = [f"d{k}" for k in range(1, count + 1)] + ["approx"]
    energy = {n: F.coalesce(a.energy(F.col(n)), F.lit(0.0)) for n in names}
    whole = sum(energy.values(), F.lit(0.0))
    out: dict[str, Column] = {}

    def bits(n: str) -> Column:
        return a.let(energy[n], lambda e: F.aggregate(n, F.lit(0.0), lambda s, v: s - F.when((v != 0) & (e > 0), (v * v / e) * F.log2(v * v / e)).otherwise(0.0)))

    for n in names:
        out[f"{n}_share"] = F.when(whole > 0, energy[n] / whole).otherwise(0.0)
        out[f"{n}_entropy"] = F.coalesce(bits(n), F.lit(0.0))
    return out
