"""Column expressions: coercion, quality flags, calendar keys, unit transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: season names by month % 12 // 3.
SEASONS = ("DJF", "MAM", "JJA", "SON")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so IS NOT NULL means finite from here on."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def numeric(x: Column) -> Column:
    return finite(x.try_cast("double"))


def utc_timestamp(x: Column) -> Column:
    """Unparsable text becomes NULL. Offsets in the text are applied, then dropped."""
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def floor_minute(ts: Column) -> Column:
    return F.date_trunc("MINUTE", ts).cast("timestamp_ntz")


def floor_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def floor_six_hours(ts: Column) -> Column:
    return floor_day(ts) + hours_interval(F.floor(F.hour(ts) / 6) * 6)


def hours_interval(h: Column | int) -> Column:
    h = F.lit(h) if isinstance(h, int) else h
    return F.make_dt_interval(F.lit(0), h.cast("int"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def qc_ok(q: Column) -> Column:
    """A missing flag counts as good."""
    return q.isNull() | (q == 0)


def qc_strict(q: Column) -> Column:
    return F.coalesce(q == 0, F.lit(False))


def known_true(flag: Column) -> Column:
    """A flag lost in a join counts as bad."""
    return F.coalesce(flag, F.lit(False))


def close_to(x: Column, value: float, atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    return F.abs(x - F.lit(value)) <= F.lit(atol + rtol * abs(value))


def usable_value(x: Column) -> Column:
    """Finite and non-negative, never NULL."""
    return F.coalesce(x >= 0, F.lit(False))


def calendar_angles(ts: Column) -> dict[str, Column]:
    day = F.lit(2 * math.pi / 24) * (F.hour(ts) + F.minute(ts) / F.lit(60.0))
    year = F.lit(2 * math.pi / 365.25) * F.dayofyear(ts)
    return {
        "sin_hour": F.sin(day),
        "cos_hour": F.cos(day),
        "sin_year": F.sin(year),
        "cos_year": F.cos(year),
    }


def season_of(month: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SEASONS])
    return F.element_at(names, (F.floor((month % 12) / 3) + 1).cast("int"))


def clip_low(x: Column, low: float = 0.0) -> Column:
    """NULL stays NULL (``greatest`` alone would turn it into the bound)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def log1p_clipped(x: Column) -> Column:
    return F.log1p(clip_low(x))


def log_features(columns: list[str], exact: tuple[str, ...] = ("pnsd_gmd", "N_CN_CPC_STP_B")) -> list[Column]:
    """log1p for number columns (``n_`` prefix or named), others unchanged."""
    return [
        log1p_clipped(F.col(c)).alias(c) if c.startswith("n_") or c in exact else F.col(c)
        for c in columns
    ]


def epoch_day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def epoch_week(ts: Column) -> Column:
    """Seven-day blocks anchored at the epoch (they start on Thursdays)."""
    return F.floor(epoch_day(ts) / 7).cast("bigint")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def wind_u(speed: Column, degrees: Column) -> Column:
    return -speed * F.sin(F.radians(degrees))


def wind_v(speed: Column, degrees: Column) -> Column:
    return -speed * F.cos(F.radians(degrees))


def qc_bits_ok(q: Column, strict: bool = False) -> Column:
    """Only bit 4 (value 8, 'indeterminate') may be set; strict allows no bit. Missing is bad."""
    q = F.coalesce(q.cast("bigint"), F.lit(-1).cast("bigint"))
    return q == 0 if strict else (q >= 0) & (q.bitwiseAND(F.lit(~8).cast("bigint")) == 0)


def retire_bit4(q: Column) -> Column:
    """Older files use bit 4 for a failed test: such minutes are marked missing."""
    return F.when(q.cast("bigint").bitwiseAND(F.lit(8).cast("bigint")) != 0, F.lit(-1).cast("bigint")).otherwise(q.cast("bigint"))


def in_valid_range(x: Column, low: Column, high: Column) -> Column:
    """Mask outside [low, high]; a missing bound does not restrict."""
    return F.when(F.coalesce(x >= low, x.isNotNull()) & F.coalesce(x <= high, x.isNotNull()), x)
