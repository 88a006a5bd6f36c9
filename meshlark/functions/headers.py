"""Header fields as SQL expression text: times, levels, product templates, sign-magnitude numbers."""

from __future__ import annotations

#: Seconds of a time unit, and months of one.
UNIT_SECONDS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1, 14: 900, 15: 1800}
UNIT_MONTHS = {3: 1, 4: 12, 5: 120, 6: 360, 7: 1200}
#: Where the ensemble octets of a product template begin.
ENSEMBLE_AT = {1: 34, 11: 34, 60: 34, 61: 34, 41: 36, 43: 36, 45: 47, 47: 47}
#: Where a product template has the end of the interval, the number of ranges, the missing count and the first range.
INTERVAL_AT = {8: (34, 41, 42, 46), 9: (47, 54, 55, 59), 10: (35, 42, 43, 47), 11: (37, 44, 45, 49), 12: (36, 43, 44, 48), 42: (36, 43, 44, 48), 43: (39, 46, 47, 51), 46: (47, 54, 55, 59), 47: (50, 57, 58, 62), 61: (44, 51, 52, 56)}
#: The least length of each section.
SECTION_LEAST = {1: 21, 2: 5, 3: 14, 4: 9, 5: 11, 6: 6, 7: 5}


def _case(of: str, values: dict[int, object], other: str = "NULL") -> str:
    return f"(CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END)"


def valid_time(reference: str, unit: str, n: str, year: str = "year", duck: bool = False) -> str:
    """The reference time plus n units; null for unknown units. Months and years keep the day of the month and run over its end (31 January plus a month: 2 or 3 March)."""
    seconds, months = _case(unit, UNIT_SECONDS), _case(unit, UNIT_MONTHS)
    total = f"(year({reference}) * 12 + month({reference}) - 1 + ({n}) * {months})"
    y, m = f"CAST(floor({total} / 12) AS INT)", f"CAST({total} - 12 * floor({total} / 12) + 1 AS INT)"
    if duck:
        moved = f"(CAST(make_date({y}, {m}, 1) AS TIMESTAMP) + to_days(CAST(day({reference}) - 1 AS INT)) + ({reference} - date_trunc('day', {reference})))"
        return f"(CASE WHEN {seconds} IS NOT NULL THEN {reference} + to_seconds(({n}) * {seconds}) WHEN {months} IS NOT NULL THEN {moved} END)"
    moved = f"timestampadd(SECOND, CAST(unix_timestamp({reference}) - unix_timestamp(date_trunc('DAY', {reference})) AS INT), CAST(date_add(make_date({y}, {m}, 1), day({reference}) - 1) AS TIMESTAMP))"
    return f"(CASE WHEN {seconds} IS NOT NULL THEN CAST(timestampadd(SECOND, ({n}) * {seconds}, {reference}) AS TIMESTAMP_NTZ) WHEN {months} IS NOT NULL THEN CAST({moved} AS TIMESTAMP_NTZ) END)"


def level(scale: str, value: str) -> str:
    """value * 10^-scale of a surface; null if either is missing (-127, 2^32 - 1)."""
    return f"(CASE WHEN ({scale}) = -127 OR ({value}) = 4294967295 THEN NULL ELSE ({value}) * pow(1e1, -({scale})) END)"


def limit(scale: str, value: str) -> str:
    """value * 10^-scale of a probability limit; null if either is missing (-127, -(2^31 - 1))."""
    return f"(CASE WHEN ({scale}) = -127 OR ({value}) = -2147483647 THEN NULL ELSE ({value}) * pow(1e1, -({scale})) END)"


def ensemble_at(template: str, ranges: str) -> str:
    """The place of the ensemble octets in a product section, null where there are none; templates 33 and 34 have it behind their bands."""
    bands = f"(CASE WHEN ({template}) IN (33, 34) AND ({ranges}) > 0 THEN 34 + 11 * (({ranges}) - 1) END)"
    return f"coalesce({_case(template, ENSEMBLE_AT)}, {bands})"


def interval_at(template: str) -> str:
    """The place of the interval's end in a product section, null where there is none."""
    return _case(template, {k: v[0] for k, v in INTERVAL_AT.items()})


def section_ok(number: str, length: str) -> str:
    """Whether a section of this number may have this length; unknown numbers may not."""
    return f"(({length}) >= {_case(number, SECTION_LEAST, '9223372036854775807')})"


def sign_magnitude(value: str, bits: int) -> str:
    """The signed number of an unsigned one whose highest bit is the sign."""
    high = 1 << (bits - 1)
    return f"(CASE WHEN ({value}) >= {high} THEN -(({value}) - {high}) ELSE ({value}) END)"


def angle_scale(basic: str, parts: str) -> str:
    """What stored angles are divided by: 10^6, or the parts of the basic angle if both are given."""
    return f"(CASE WHEN ({basic}) IN (0, 4294967295) OR ({parts}) IN (0, 4294967295) THEN 1e6 ELSE ({parts}) * 1e0 / ({basic}) END)"
