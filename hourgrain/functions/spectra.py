"""Array expressions over one spectrum per row, and the small driver-side axis arithmetic.

A spectrum is ARRAY<DOUBLE>, one value per channel, missing channels NULL. The channel axis is a
short list (tens of diameters), so edges and weights are computed once on the driver and enter the
plan as array literals; everything per row stays in the JVM without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

SEMANTICS = ("bin_concentration", "dndlog10dp", "dndln_dp")

# The six integration bands in nm.
BANDS = {
    "n_15_25": (15.0, 25.0),
    "n_25_50": (25.0, 50.0),
    "n_50_100": (50.0, 100.0),
    "n_100_300": (100.0, 300.0),
    "n_300_500": (300.0, 500.0),
    "n_15_300": (15.0, 300.0),
}
SPECTRUM_COLUMNS = (
    "n_15_25", "n_25_50", "n_50_100", "n_100_300", "n_15_300",
    "frac_15_25", "frac_25_50", "frac_50_100", "frac_100_300", "pnsd_gmd",
)
MIN_BAND_COVERAGE = 0.75


def log10_edges(diameters: Sequence[float]) -> list[float]:
    """n+1 edges: midpoints of the log centres, outer edges half a gap further out."""
    if len(diameters) < 2 or any(not math.isfinite(d) or d <= 0 for d in diameters):
        raise ValueError("an axis needs two or more finite positive diameters")
    if any(b <= a for a, b in zip(diameters, diameters[1:])):
        raise ValueError("diameters must be strictly increasing")
    c = [math.log10(d) for d in diameters]
    inner = [(a + b) / 2 for a, b in zip(c, c[1:])]
    return [c[0] - (c[1] - c[0]) / 2, *inner, c[-1] + (c[-1] - c[-2]) / 2]


def log10_widths(diameters: Sequence[float]) -> list[float]:
    e = log10_edges(diameters)
    return [b - a for a, b in zip(e, e[1:])]


def geometric_grid(low: float, high: float, n: int) -> list[float]:
    """n cell centres that tile [low, high] with equal log widths."""
    step = (math.log(high) - math.log(low)) / n
    return [math.exp(math.log(low) + step * (k + 0.5)) for k in range(n)]


def cells(diameters: Sequence[float], semantics: str, widths: Sequence[float] | None) -> list[tuple[float, float]]:
    """Log10 extent of each channel: centred for densities, forward for per-bin concentrations."""
    if semantics == "bin_concentration":
        if widths is None:
            raise ValueError("per-bin concentrations need explicit channel widths")
        return [(math.log10(d), math.log10(d) + w) for d, w in zip(diameters, widths)]
    e = log10_edges(diameters)
    return list(zip(e, e[1:]))


def overlaps(extent: Sequence[tuple[float, float]], low: float, high: float) -> list[float]:
    """Width of each log10 cell inside [low, high] nm."""
    lo, hi = math.log10(low), math.log10(high)
    return [max(0.0, min(b, hi) - max(a, lo)) for a, b in extent]


def array_lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def array_sum(x: Column) -> Column:
    """Sum of an array, missing elements count as zero."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def dot(x: Column, weights: Column) -> Column:
    """Weighted sum of an array, missing elements count as zero."""
    return array_sum(F.zip_with(x, weights, lambda v, w: v * w))


def density_log10(x: Column, semantics: str, widths: Column | None = None) -> Column:
    """dN/dlog10D from any of the three input semantics."""
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown spectrum semantics {semantics!r}")
    if semantics == "bin_concentration":
        if widths is None:
            raise ValueError("per-bin concentrations need explicit channel widths")
        return F.zip_with(x, widths, lambda v, w: v / w)
    if semantics == "dndln_dp":
        return F.transform(x, lambda v: v * F.lit(math.log(10.0)))
    return x


def range_weights(
    diameters: Sequence[float], semantics: str, low: float, high: float, widths: Sequence[float] | None = None
) -> list[float]:
    """Per-channel factor that turns stored values into the number between low and high nm."""
    extent = cells(diameters, semantics, widths)
    part = overlaps(extent, low, high)
    if semantics == "bin_concentration":
        return [p / (b - a) if b > a else 0.0 for p, (a, b) in zip(part, extent)]
    scale = math.log(10.0) if semantics == "dndln_dp" else 1.0
    return [p * scale for p in part]


def range_integral(
    x: Column, diameters: Sequence[float], semantics: str, low: float, high: float, widths: Sequence[float] | None = None
) -> Column:
    return dot(x, array_lit(range_weights(diameters, semantics, low, high, widths)))


def full_integral(x: Column, diameters: Sequence[float], semantics: str, widths: Sequence[float] | None = None) -> Column:
    if semantics == "bin_concentration":
        return array_sum(x)
    used = widths if widths is not None else log10_widths(diameters)
    return dot(density_log10(x, semantics), array_lit(used))


def regrid(
    x: Column,
    diameters: Sequence[float],
    grid: Sequence[float],
    semantics: str = "dndlog10dp",
    widths: Sequence[float] | None = None,
    scale: bool = True,
) -> Column:
    """Interpolate over ln-diameter through the row's usable channels onto ``grid``.

    Usable means finite and non-negative. Each target is the density at the grid point times the
    target width (``scale``). The result is NULL when the usable channels do not span the grid.

    The native neighbours of every grid point are known up front, so the usual case is two array
    reads; only a point with a missing neighbour searches for the nearest usable channels.
    """
    if grid[0] < diameters[0] or grid[-1] > diameters[-1]:
        raise ValueError("the target grid leaves the native range")
    ln_d = [math.log(d) for d in diameters]
    target_w = log10_widths(grid) if scale else [1.0] * len(grid)
    density = density_log10(x, semantics, array_lit(widths) if widths is not None else None) if scale else x
    axis = array_lit(ln_d)
    targets = []
    for g, w in zip(grid, target_w):
        i = max(j for j, d in enumerate(diameters) if d <= g)
        k = min(i + 1, len(diameters) - 1)
        share = (math.log(g) - ln_d[i]) / (ln_d[k] - ln_d[i]) if k > i else 0.0
        targets.append(
            F.struct(
                F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(share).alias("t"), F.lit(math.log(g)).alias("at"), F.lit(w).alias("w")
            )
        )

    def usable(v: Column) -> Column:
        return F.coalesce(v >= 0, F.lit(False))

    def mapped(row: Column) -> Column:
        def point(g: Column) -> Column:
            a, b = F.get(row, g["i"]), F.get(row, g["k"])
            near = F.when(usable(a) & usable(b), a + (b - a) * g["t"]).otherwise(
                _nearest(row, axis, g["i"], g["at"], len(diameters))
            )
            return near * g["w"]

        return F.transform(F.array(*targets), point)

    low = sum(1 for d in diameters if d <= grid[0])
    high = sum(1 for d in diameters if d >= grid[-1])
    spans = F.exists(F.slice(x, 1, low), usable) & F.exists(F.slice(x, len(diameters) - high + 1, high), usable)
    plain = semantics == "dndlog10dp" or not scale
    # a one-element array binds a derived density once instead of once per grid point
    value = mapped(density) if plain else F.get(F.transform(F.array(density), mapped), F.lit(0))
    return F.when(F.coalesce(spans, F.lit(False)), value)


def _nearest(row: Column, axis: Column, i: Column, at: Column, n: int) -> Column:
    """Linear between the last usable channel at or below the point and the first one above it."""

    def side(start: Column, length: Column) -> Column:
        part = F.zip_with(F.slice(row, start, length), F.slice(axis, start, length), lambda v, d: F.struct(d.alias("d"), v.alias("v")))
        return F.filter(part, lambda s: F.coalesce(s["v"] >= 0, F.lit(False)))

    a = F.try_element_at(side(F.lit(1), i + 1), F.lit(-1))
    b = F.try_element_at(side(i + 2, F.lit(n)), F.lit(1))
    return F.when(b["d"].isNull() | (a["d"] == at), a["v"]).otherwise(
        a["v"] + (b["v"] - a["v"]) * (at - a["d"]) / (b["d"] - a["d"])
    )


def row_valid(x: Column, n_channels: int, supplied: Column | None = None) -> Column:
    """At least 80 % of the channels present and a positive sum."""
    present = F.size(F.filter(x, lambda v: v.isNotNull()))
    ok = (present / F.lit(float(n_channels)) >= F.lit(0.8)) & (array_sum(x) > 0)
    return ok if supplied is None else ok & F.coalesce(supplied, F.lit(False))


def channels_complete(x: Column, diameters: Sequence[float], low: float, high: float) -> Column:
    """Every channel whose cell touches (low, high) is present and non-negative."""
    extent = cells(diameters, "dndlog10dp", None)
    lo, hi = math.log10(low), math.log10(high)
    need = [j for j, (a, b) in enumerate(extent) if b > lo and a < hi]
    part = F.slice(x, need[0] + 1, len(need))
    return F.forall(part, lambda v: F.coalesce(v >= 0, F.lit(False)))


def non_negative(x: Column) -> Column:
    """Negative values become missing."""
    return F.transform(x, lambda v: F.when(v >= 0, v))


def band_value(x: Column, diameters: Sequence[float], low: float, high: float) -> Column:
    """Range integral, missing when under 75 % of the expected overlap is present."""
    part = overlaps(cells(diameters, "dndlog10dp", None), low, high)
    clean = non_negative(x)
    seen = array_sum(F.zip_with(clean, array_lit(part), lambda v, w: F.when(v.isNotNull(), w)))
    return F.when(seen >= F.lit(MIN_BAND_COVERAGE * sum(part)), dot(clean, array_lit(part)))


def band_values(x: Column, diameters: Sequence[float]) -> dict[str, Column]:
    return {name: band_value(x, diameters, lo, hi) for name, (lo, hi) in BANDS.items()}


def band_fractions() -> dict[str, Column]:
    """Shares of the 15-300 nm total, from columns named like BANDS."""
    total = F.nullif(F.col("n_15_300"), F.lit(0.0))
    return {f"frac_{n[2:]}": F.col(n) / total for n in BANDS if n != "n_15_300"}


def geometric_mean_diameter(x: Column, diameters: Sequence[float]) -> Column:
    widths = log10_widths(diameters)
    clean = non_negative(x)
    weight = dot(clean, array_lit(widths))
    moment = dot(clean, array_lit([w * math.log10(d) for w, d in zip(widths, diameters)]))
    return F.when(weight > 0, F.pow(F.lit(10.0), moment / weight))


def cutoff_weights(grid: Sequence[float], cutoff: float) -> list[float]:
    """Share of each equal-log-width bin above the cutoff diameter."""
    e = log10_edges(grid)
    c = math.log10(cutoff)
    if not e[0] < c < e[-1]:
        raise ValueError("the cutoff lies outside the grid")
    return [min(1.0, max(0.0, (b - max(a, c)) / (b - a))) for a, b in zip(e, e[1:])]


def count_above(bins: Column, grid: Sequence[float], cutoff: float) -> Column:
    return dot(bins, array_lit(cutoff_weights(grid, cutoff)))


def fraction_above(bins: Column, grid: Sequence[float], cutoff: float) -> Column:
    return count_above(bins, grid, cutoff) / F.nullif(array_sum(bins), F.lit(0.0))


def bin_fractions(bins: Column, keep: int | None = None) -> Column:
    total = F.nullif(array_sum(bins), F.lit(0.0))
    share = F.transform(bins, lambda v: v / total)
    return share if keep is None else F.slice(share, 1, keep)


def channel_diameter(name: str) -> float:
    return float(name[2:].replace("_", "."))


def channel_axis(columns: Sequence[str]) -> list[tuple[float, str]]:
    """(diameter, column) for every ``D_*`` column, smallest first."""
    return sorted((channel_diameter(c), c) for c in columns if c.startswith("D_"))
