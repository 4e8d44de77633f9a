"""The four representations of a series, as array expressions and as an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def raw(x: Column) -> Column:
    return x.cast("array<double>")


def once(value: Column, f) -> Column:
    """f(value) with the value computed once a row: a lambda's argument is bound, an expression is computed at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def diff1_smooth(x: Column) -> Column:
    """First difference under a moving mean of five, its ends repeated; one point shorter."""

    def smooth(y: Column) -> Column:
        last = F.size(y) - 2

        def mean(i: Column) -> Column:
            at = [F.least(F.greatest(i + k, F.lit(0)), last) for k in (-2, -1, 0, 1, 2)]
            steps = [F.get(y, k + 1) - F.get(y, k) for k in at]
            return sum(steps[1:], steps[0]) / 5

        return F.transform(F.sequence(F.lit(0), last), mean)

    return once(raw(x), smooth)


def diff2(x: Column) -> Column:
    """Difference of the difference, two points shorter."""
    return once(raw(x), lambda y: F.transform(
        F.sequence(F.lit(2), F.size(y) - 1), lambda i: (F.get(y, i) - F.get(y, i - 1)) - (F.get(y, i - 1) - F.get(y, i - 2))))


@F.pandas_udf(ArrayType(DoubleType()))
def fft_abs(x: pd.Series) -> pd.Series:
    """Magnitudes of the real Fourier transform; equal lengths go through one call."""
    lengths = x.map(len)
    out = pd.Series([None] * len(x), index=x.index, dtype=object)
    for n in lengths.unique():
        own = lengths.index[lengths == n]
        block = np.abs(np.fft.rfft(np.stack([np.asarray(x[i], np.float64) for i in own]), axis=1))
        for i, row in zip(own, block, strict=True):
            out[i] = row
    return out


SHORT, CHIRPED = 128, 2048
LARGEST = 31  # a length with a larger prime factor goes by a convolution


def _number(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _turned(a: Column, part: Column, whole: int) -> Column:
    """a exp(-2 pi i part / whole)."""
    angle = (part % whole) * F.lit(-2 * np.pi / whole)
    c, s = F.cos(angle), F.sin(angle)
    return _number(a["re"] * c - a["im"] * s, a["re"] * s + a["im"] * c)


def _factors(n: int) -> list[int]:
    """The factors of the passes: fours first, for fewer passes."""
    out = []
    for p in (4, *range(2, n + 1)):
        while n % p == 0:
            out.append(p)
            n //= p
    return out


def _added(n: int, term) -> Column:
    if n <= 5:
        terms = [term(F.lit(t)) for t in range(n)]
        return _number(sum((t["re"] for t in terms[1:]), terms[0]["re"]), sum((t["im"] for t in terms[1:]), terms[0]["im"]))
    zero = _number(F.lit(0.0), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, lambda acc, t: _number(acc["re"] + term(t)["re"], acc["im"] + term(t)["im"]))


def _pass(n: int, r: int, left: int, apart: int):
    """One pass of factor r: transforms of ``left`` points, ``apart`` of them side by side, become r times as many of left / r points."""
    m = left // r

    def one(x: Column, o: Column) -> Column:
        q, u = o % apart, F.floor(o / apart).cast("int")
        j, p = u % r, F.floor(u / r).cast("int")
        return _added(r, lambda t: _turned(F.get(x, q + (p + t * m) * apart), j.cast("bigint") * (p + t * m), left))

    return lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: one(x, o))


def _transform(z: Column, n: int) -> Column:
    """The discrete Fourier transform of an array of ``n`` complex numbers, a pass for each factor of n; the results come out in order."""
    left, apart = n, 1
    for r in _factors(n):
        z = once(z, _pass(n, r, left, apart))
        left, apart = left // r, apart * r
    return z


def _chirped(z: Column, n: int) -> Column:
    """The transform of any length as a convolution with a chirp, by transforms of a power of two points."""
    m = 1 << (2 * n - 2).bit_length()
    square = lambda t: t.cast("bigint") * t  # noqa: E731  a turn by t t / 2 n
    every, unit, nothing = F.sequence(F.lit(0), F.lit(m - 1)), _number(F.lit(1.0), F.lit(0.0)), _number(F.lit(0.0), F.lit(0.0))
    # the chirp's own transform has no column in it: the optimiser computes it once
    wave = _transform(F.transform(every, lambda t: F.when((t < n) | (t > m - n), _turned(unit, 2 * n - square(F.least(t, m - t)) % (2 * n), 2 * n)).otherwise(nothing)), m)
    ahead = _transform(once(z, lambda x: F.transform(every, lambda t: F.when(t < n, _turned(F.get(x, t), square(t), 2 * n)).otherwise(nothing))), m)
    both = F.zip_with(ahead, wave, lambda a, b: _number(a["re"] * b["re"] - a["im"] * b["im"], -(a["re"] * b["im"] + a["im"] * b["re"])))
    back = F.slice(_transform(both, m), 1, n)
    return F.transform(back, lambda c, k: _turned(_number(c["re"] / m, -c["im"] / m), square(k), 2 * n))


def _direct(x: Column, length: int) -> Column:
    """Magnitudes by the defining sums, length squared."""
    points = F.sequence(F.lit(0), F.lit(length - 1))

    def part(y: Column, k: Column, wave) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, t: acc + F.get(y, t) * wave(F.lit(2 * np.pi / length) * ((k * t) % length)))

    return once(raw(x), lambda y: F.transform(F.sequence(F.lit(0), F.lit(length // 2)), lambda k: F.hypot(part(y, k, F.cos), part(y, k, F.sin))))


def fft_abs_sql(x: Column, length: int) -> Column:
    """The same for plans without Python: n log n by the length's prime factors, or by a chirp where one is large.

    Up to SHORT points the sums are as fast and their plan is smaller; a length of over CHIRPED points with a large prime factor goes by the sums too,
    as its nested expression would pass the analyser's usual number of iterations."""
    fast = max(_factors(length), default=1) <= LARGEST
    if length <= SHORT or not fast and length > CHIRPED:
        return _direct(x, length)
    z = F.transform(raw(x), lambda v: _number(v, F.lit(0.0)))
    whole = _transform(z, length) if fast else _chirped(z, length)
    return F.transform(F.slice(whole, 1, length // 2 + 1), lambda v: F.hypot(v["re"], v["im"]))


COLUMNS = {"raw": raw, "diff1_smooth": diff1_smooth, "diff2": diff2, "fft_abs": fft_abs}


def blocks(x: np.ndarray) -> dict[str, np.ndarray]:
    """All representations of a block of series of one length (rows)."""
    d = np.diff(x, axis=1)
    padded = np.pad(d, ((0, 0), (2, 2)), mode="edge")
    n = d.shape[1]
    return {"raw": x, "diff1_smooth": sum(padded[:, k:k + n] for k in range(5)) / 5, "diff2": np.diff(d, axis=1), "fft_abs": np.abs(np.fft.rfft(x, axis=1))}
