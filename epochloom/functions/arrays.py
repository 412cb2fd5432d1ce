"""Array expressions over channel-major epochs and plain vectors."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Col = str | Column


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` names it inside a lambda function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vsum(vec: Col) -> Column:
    return F.aggregate(_c(vec), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


def vmean(vec: Col) -> Column:
    vec = _c(vec)
    return vsum(vec) / F.size(vec)


def dot(a: Col, b: Col) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(vec: Col) -> Column:
    return F.sqrt(F.aggregate(
        _c(vec), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")
    ))


def l2_normalise(vec: Col, eps: float = 1e-8) -> Column:
    """Unit vector with the small additive floor on the norm."""
    return bound(_c(vec), lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / (n + F.lit(eps)))))


def reshape(vec: Col, channels: int, times: int) -> Column:
    vec = _c(vec)
    return F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.slice(vec, c * times + 1, times),
    )


def is_epoch(eeg: Col) -> Column:
    """Rank-2, rectangular and non-empty on both axes."""
    eeg = _c(eeg)
    ok = (
        eeg.isNotNull() & (F.size(eeg) > 0)
        & F.forall(eeg, lambda r: r.isNotNull() & (F.size(r) > 0) & (F.size(r) == F.size(eeg[0])))
    )
    return F.coalesce(ok, F.lit(False))


def scale(eeg: Col, factor: float) -> Column:
    return F.transform(_c(eeg), lambda r: F.transform(r, lambda v: v.cast("double") * F.lit(factor)))


def _edge(i: Column, total: Column, bins: int) -> Column:
    """Integer bin edge ``i * total // bins``; never by floating point."""
    product = i.cast("long") * total.cast("long")
    return ((product - F.pmod(product, F.lit(bins))) / F.lit(bins)).cast("int")


def block_mean(vec: Col, bins: int) -> Column:
    """Mean of each of ``bins`` blocks; too few samples repeat, equal size is kept."""
    vec = _c(vec)
    total = F.size(vec)

    def one(i: Column) -> Column:
        start = _edge(i, total, bins)
        stop = F.greatest(start + 1, _edge(i + 1, total, bins))
        return vmean(F.slice(vec, start + 1, stop - start))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)


def pool_time(eeg: Col, n_times: int) -> Column:
    if n_times < 1:
        raise ValueError("n_times must be positive")
    return F.transform(_c(eeg), lambda r: F.when(
        F.size(r) == n_times, F.transform(r, lambda v: v.cast("double"))
    ).otherwise(block_mean(r, n_times)))


def pool_channels(eeg: Col, n_channels: int) -> Column:
    """Mean of neighbouring channels; unchanged when there are no more than asked for."""
    if n_channels < 1:
        raise ValueError("n_channels must be positive")
    eeg = _c(eeg)
    total = F.size(eeg)

    def one(i: Column) -> Column:
        start = _edge(i, total, n_channels)
        stop = F.greatest(start + 1, _edge(i + 1, total, n_channels))
        block = F.slice(eeg, start + 1, stop - start)
        return F.transform(
            F.sequence(F.lit(0), F.size(eeg[0]) - 1),
            lambda t: vmean(F.transform(block, lambda r: F.get(r, t))),
        )

    pooled = F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), one)
    as_double = F.transform(eeg, lambda r: F.transform(r, lambda v: v.cast("double")))
    return F.when(total <= n_channels, as_double).otherwise(pooled)


def average_reference(eeg: Col) -> Column:
    """Subtract the mean over channels from every sample."""
    eeg = _c(eeg)
    means = F.transform(
        F.sequence(F.lit(0), F.size(eeg[0]) - 1),
        lambda t: vmean(F.transform(eeg, lambda r: F.get(r, t))),
    )
    return F.transform(F.array(means), lambda m: F.transform(
        eeg, lambda r: F.zip_with(r, m, lambda v, x: v.cast("double") - x)
    ))[0]


def demean(eeg: Col) -> Column:
    return F.transform(_c(eeg), lambda r: F.transform(
        F.array(vmean(r)), lambda m: F.transform(r, lambda v: v.cast("double") - m)
    )[0])


def baseline(eeg: Col, fraction: float = 0.2) -> Column:
    """Subtract the mean of the leading samples: one fifth of them, at least one."""
    def lead(r: Column) -> Column:
        return vmean(F.slice(r, F.lit(1), F.greatest(
            F.lit(1), F.floor(F.size(r) * F.lit(fraction)).cast("int")
        )))
    return F.transform(_c(eeg), lambda r: F.transform(
        F.array(lead(r)), lambda m: F.transform(r, lambda v: v.cast("double") - m)
    )[0])


def peak_to_peak(eeg: Col) -> Column:
    flat = F.flatten(_c(eeg))
    return F.array_max(flat).cast("double") - F.array_min(flat).cast("double")


def stored_peak_to_peak(eeg: Col) -> Column:
    """Peak-to-peak in the type that the values are stored in: of floats it is rounded to a float."""
    flat = F.flatten(_c(eeg))
    return F.array_max(flat) - F.array_min(flat)


def channel_peak_to_peak(eeg: Col) -> Column:
    return F.transform(_c(eeg), lambda r: F.array_max(r).cast("double") - F.array_min(r).cast("double"))


def fit_width(vec: Col, width: int) -> Column:
    """Crop or right-pad with zeros to exactly ``width`` values."""
    vec = _c(vec)
    cut = F.transform(F.slice(vec, 1, width), lambda v: v.cast("double"))
    return F.concat(cut, F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.lit(0), F.lit(width) - F.size(vec))))


def fit_epoch_width(eeg: Col, width: int) -> Column:
    return F.transform(_c(eeg), lambda r: fit_width(r, width))


def features(eeg: Col, width: int) -> Column:
    """Flattened channel-major features of exactly ``width`` values."""
    return fit_width(F.flatten(_c(eeg)), width)


def argmax_index(vec: Col) -> Column:
    """0-based position of the first largest value."""
    vec = _c(vec)
    return F.array_position(vec, F.array_max(vec)).cast("int") - 1
