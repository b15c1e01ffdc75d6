"""Readings as words. Phrases are data values: a short code, then a phrase of our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(cases: list[tuple[Column, str]], other: str) -> Column:
    out = None
    for cond, phrase in cases:
        out = F.when(cond, phrase) if out is None else out.when(cond, phrase)
    return out.otherwise(other)


def _d(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))


def band_power(avg_w: str | Column, max_w: str | Column) -> Column:
    """Average power as a share of the highest seen; a highest of 0 or less counts as share 0."""
    share = F.when(_d(max_w) > 0, _d(avg_w) / _d(max_w)).otherwise(0.0)
    return _chain([(_d(avg_w) <= 0, "power: none"), (share < 0.1, "power: minimal"), (share < 0.4, "power: low"), (share < 0.7, "power: moderate"), (share < 0.9, "power: high")], "power: near maximum")


def band_voltage(low: str | Column, high: str | Column, stddev: str | Column) -> Column:
    spread = _d(high) - _d(low)
    sag = F.when(_d(low) < 210, "voltage: sag below 210V").when(_d(low) < 220, "voltage: dip below 220V")
    sway = _chain([(_d(stddev) > 12, "voltage: severe instability"), (_d(stddev) > 8, "voltage: high variance"), (_d(stddev) > 5, "voltage: some fluctuation")], "voltage: stable")
    wide = F.when(spread > 20, F.concat(F.lit("voltage: range of "), F.bround(spread, 0).cast("int").cast("string"), F.lit("V")))
    return F.concat_ws(". ", sag, sway, wide)


def band_temperature(high: str | Column) -> Column:
    return _chain([(_d(high) > 70, "temperature: critical"), (_d(high) > 60, "temperature: high"), (_d(high) > 50, "temperature: elevated"), (_d(high) > 35, "temperature: normal")], "temperature: cool")


def band_leak(ma: str | Column) -> Column:
    return _chain([(_d(ma) > 8, "leakage: dangerous"), (_d(ma) > 6, "leakage: elevated"), (_d(ma) > 4, "leakage: slightly elevated"), (_d(ma) > 2, "leakage: normal")], "leakage: minimal")


def band_fan(rpm: str | Column, power_w: str | Column) -> Column:
    r, p = _d(rpm), _d(power_w)
    return _chain([((r == 0) & (p > 0), "fan: not turning under load"), ((r < 500) & (p > 1000), "fan: critically slow"), ((r < 1000) & (p > 5000), "fan: slow"), (r > 0, "fan: normal")], "fan: idle")


def band_errors(count: str | Column, codes: str | Column | None = None) -> Column:
    n = _d(count)
    base = _chain([(n == 0, "errors: none"), (n <= 2, "errors: few"), (n <= 5, "errors: several")], "errors: storm")
    if codes is None:
        return base
    text = F.col(codes) if isinstance(codes, str) else codes
    named = text.isNotNull() & ~text.isin("null", "[]", "") & (n > 0)
    return F.when(named, F.concat(base, F.lit(" ("), text, F.lit(")"))).otherwise(base)


def band_status(changes: str | Column) -> Column:
    return _chain([(_d(changes) <= 2, "status: stable"), (_d(changes) <= 5, "status: some changes"), (_d(changes) <= 10, "status: frequent changes")], "status: flapping")


def band_connectivity(dbm: str | Column) -> Column:
    c = F.col(dbm) if isinstance(dbm, str) else dbm
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c < -90, "signal: very weak").when(c < -80, "signal: weak").when(c < -70, "signal: moderate").otherwise("signal: strong")
