"""Signal functions over array columns, as Catalyst expressions: a clip is an array of doubles in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: inside a lambda over elements Spark would compute it again for each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_places(v: Column | str, n: int) -> Column:
    """A double rounded half away from zero, as SQL engines round doubles: scaled by a power of ten, rounded, scaled back. A small negative number becomes a negative zero.

    Spark's own round takes the shortest decimal text of a double, which differs at ties and has no negative zero.
    """
    c = F.col(v) if isinstance(v, str) else v
    return F.signum(c) * F.round(F.abs(c) * 10.0**n, 0) / 10.0**n


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def moment(x: Column, k: int) -> Column:
    """Central population moment."""
    return F.when(F.size(x) > 0, let(mean(x), lambda m: total(F.transform(x, lambda v: F.pow(v - m, F.lit(k)))) / F.size(x)))


def std(x: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(moment(x, 2))


def median(x: Column) -> Column:
    n = F.size(x)
    return let(F.array_sort(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def normalize(x: Column, method: str) -> Column:
    """minmax, zscore (population) or robust (median and its absolute deviation); no spread gives zeros."""
    if method == "minmax":
        low, spread = lambda: F.array_min(x), lambda low: F.array_max(x) - low
    elif method == "zscore":
        low, spread = lambda: mean(x), lambda low: std(x)
    elif method == "robust":
        low, spread = lambda: median(x), lambda low: median(F.transform(x, lambda v: F.abs(v - low)))
    else:
        raise ValueError("method is minmax, zscore or robust")
    scaled = lambda a, s: F.transform(x, lambda v: F.when(s == 0, 0.0).otherwise((v - a) / s))
    return let(low(), lambda a: let(spread(a), lambda s: scaled(a, s)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def peak_normalize(x: Column, to: float = 1.0) -> Column:
    """Scaled so that the largest magnitude is `to`; silence stays."""
    return let(peak(x), lambda p: F.transform(x, lambda v: F.when(p == 0, v).otherwise(v * to / p)))


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x))


def energy(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v))


def sign_changes(x: Column) -> Column:
    """Share of neighbours that differ in sign, zero counting as positive."""
    s = F.transform(x, lambda v: F.when(v < 0, -1).otherwise(1))
    pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    return F.when(F.size(x) > 1, total(pairs) / (F.size(x) - 1)).otherwise(0.0)


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.size(x)), lambda a, b: b - a)


def silent(x: Column, db: float = -50.0) -> Column:
    return rms(x) < 10 ** (db / 20)


def clean(x: Column) -> Column:
    """NaN and infinite values replaced by 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def fit(x: Column, n: int, tile: bool = False) -> Column:
    """Exactly n values: the centre of longer arrays; shorter ones padded with zeros, or repeated."""
    start = F.floor((F.size(x) - n) / 2).cast("int")
    longer = F.slice(x, start + 1, n)
    if tile:
        times = F.ceil(F.lit(float(n)) / F.size(x)).cast("int")
        shorter = F.slice(F.flatten(F.array_repeat(x, times)), 1, n)
    else:
        shorter = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(x)))
    return F.when(F.size(x) >= n, longer).otherwise(shorter)


def segments(x: Column, size: int, hop: int, least: int | None = None, pad: bool = False) -> Column:
    """Windows of size values every hop; the first one shorter than `least` and all after it are left out.

    With pad, windows run to the end of the clip and short ones are filled with zeros.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(hop))
    cut = F.transform(starts, lambda s: F.slice(x, s + 1, size))
    if pad:
        return F.transform(cut, lambda w: F.concat(w, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(w))))
    return F.filter(cut, lambda w: F.size(w) >= (size if least is None else least))


def agc(x: Column, db: float = -23.0, cap: float = 0.95) -> Column:
    """Gain to a target RMS level, limited so that no value exceeds the cap."""
    r, p = rms(x), peak(x)
    gain = F.when(r > 0, F.least(10 ** (db / 20) / r, cap / p)).otherwise(1.0)
    return let(gain, lambda g: F.transform(x, lambda v: v * g))


def statistics(x: Column) -> dict[str, Column]:
    """Mean, std, skewness, excess kurtosis, peak, rms, crest, range, energy."""
    m2 = moment(x, 2)
    flat = m2 == 0
    return {
        "mean": mean(x),
        "std": F.sqrt(m2),
        "skew": F.when(flat, 0.0).otherwise(moment(x, 3) / F.pow(m2, 1.5)),
        "kurtosis": F.when(flat, 0.0).otherwise(moment(x, 4) / (m2 * m2) - 3),
        "peak": peak(x),
        "rms": rms(x),
        "crest": F.when(rms(x) == 0, 0.0).otherwise(peak(x) / rms(x)),
        "range": F.array_max(x) - F.array_min(x),
        "energy": energy(x),
    }


def permutation_patterns(x: Column) -> Column:
    """For each three neighbours the order of their values as a number from 0 to 5; ties go by position."""
    n = F.size(x)
    a, b, c = F.slice(x, 1, n - 2), F.slice(x, 2, n - 2), F.slice(x, 3, n - 2)
    ab = F.zip_with(a, b, lambda u, v: (u <= v).cast("int"))
    bc = F.zip_with(b, c, lambda u, v: (u <= v).cast("int"))
    ac = F.zip_with(a, c, lambda u, v: (u <= v).cast("int"))
    return F.zip_with(F.zip_with(ab, bc, lambda p, q: p * 4 + q * 2), ac, lambda p, q: p + q)


def permutation_entropy(x: Column) -> Column:
    """Base-2 entropy of the order patterns of three neighbours."""

    def of(pats: Column) -> Column:
        share = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(pats, lambda p: p == k)) / F.size(pats))
        return F.aggregate(share, F.lit(0.0), lambda a, q: a - F.when(q > 0, q * F.log2(q)).otherwise(0.0))

    return let(permutation_patterns(x), of)


def bark(hz: Column) -> Column:
    return 13 * F.atan(0.00076 * hz) + 3.5 * F.atan(F.pow(hz / 7500, F.lit(2)))


def erb(hz: Column) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * hz)


# -- strings ------------------------------------------------------------------------------


def source_of(path: Column) -> Column:
    """Leading letters of a file's name, or unknown."""
    found = F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), "^([a-z]+)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def prefix_of(path: Column) -> Column:
    """A file name without extension, up to its first underscore."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "_"), 1)


def label_of(path: Column) -> Column:
    """1 below a folder fake, 0 below real, else null."""
    return F.when(F.contains(path, F.lit("/fake/")), 1).when(F.contains(path, F.lit("/real/")), 0)


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def safe_name(text: Column, most: int = 100) -> Column:
    """A file name without characters that file systems refuse."""
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(most))


def fixed(v: Column, n: int) -> Column:
    """A number with n decimals as printf writes it: rounded from its exact binary value, ties to even. ``format_string`` rounds the shortest decimal text of a double, half up."""
    return F.translate(F.format_number(v, n), ",", "")


def human_size(n: Column) -> Column:
    """Bytes with one decimal, in steps of 1024."""
    out = F.concat(fixed(n / 1024.0**4, 1), F.lit(" TB"))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(n < 1024.0 ** (k + 1), F.concat(fixed(n / 1024.0**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(s: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    told = lambda v, unit: F.concat(fixed(v, 1), F.lit(unit))
    return F.when(s < 60, told(s, "s")).when(s < 3600, told(s / 60, "min")).otherwise(told(s / 3600, "h"))


def chunks(x: Column, n: int) -> Column:
    """An array cut into arrays of n."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(n)), lambda s: F.slice(x, s + 1, n))


def standardized(x: Column, floor: float = 1e-6) -> Column:
    """Less the mean, over the population's deviation or a floor."""
    return let(mean(x), lambda mu: let(F.greatest(std(x), F.lit(floor)), lambda sd: F.transform(x, lambda v: (v - mu) / sd)))


def edge_fit(x: Column, n: int) -> Column:
    """Exactly n values: cut at the end, or the last one repeated; an empty array stays."""
    return F.when(F.size(x) == 0, x).otherwise(F.slice(F.concat(x, F.array_repeat(F.element_at(x, -1), F.greatest(F.lit(n) - F.size(x), F.lit(0)))), 1, n))


def aligned(rows: DataFrame, x: str) -> DataFrame:
    """rows with an array filled up with zeros to the longest one of all."""
    longest = rows.agg(F.max(F.size(x)).alias("longest_"))  # one row
    filled = F.concat(x, F.array_repeat(F.lit(0.0), F.col("longest_") - F.size(x)))
    return rows.join(F.broadcast(longest), F.lit(True)).withColumn(x, filled).drop("longest_")


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def decimal_comma(number: Column) -> Column:
    """A formatted number with points for thousands and a comma for decimals."""
    return F.translate(number, ",.", ".,")


def finite_or_null(v: Column) -> Column:
    """Null in place of NaN and infinite values, which JSON does not have."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
