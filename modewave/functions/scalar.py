"""Column functions: finiteness, times in nanoseconds, directions, classes, labels."""

from __future__ import annotations

import hashlib
import json
import math
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_HOUR = 3_600_000_000_000
NS_PER_DAY = 24 * NS_PER_HOUR
#: Eight directions of flow, from east counter-clockwise.
COMPASS = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite; in Spark NaN equals itself and exceeds all numbers, so each is asked for."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def finite_or_null(c: Column | str) -> Column:
    """Missing has one form inside the engine: null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), c)


def hours(ns: Column) -> Column:
    return ns.cast("double") / float(NS_PER_HOUR)


def ns_to_timestamp(ns: Column | str) -> Column:
    ns = F.col(ns) if isinstance(ns, str) else ns
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))


def timestamp_to_ns(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("long")


def iso_utc(ns: Column | str) -> Column:
    """ISO 8601 to the second; the session's time zone is UTC."""
    return F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_index(ns: Column | str) -> Column:
    ns = F.col(ns) if isinstance(ns, str) else ns
    return F.floor(ns / F.lit(NS_PER_DAY)).cast("long")


def month_id(year: Column, month: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"))


def distance2(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Squared local distance in degrees, east-west shrunk by the cosine of the latitude."""
    dx, dy = (lon - F.lit(lon0)) * F.lit(math.cos(math.radians(lat0))), lat - F.lit(lat0)
    return dx * dx + dy * dy


def compass(u: Column, v: Column) -> Column:
    """Where a flow goes, in eight sectors of 45 degrees."""
    angle = F.pmod(F.degrees(F.atan2(v, u)) + 360.0, F.lit(360.0))
    sector = F.floor((angle + 22.5) / 45.0).cast("int") % 8
    return F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1)


def ev_class(cumulative_two: Column) -> Column:
    """How concentrated a spectrum is, from the percentage that its first two modes explain."""
    return F.when(cumulative_two >= 85, "two_modes").when(cumulative_two >= 70, "two_modes_and_minor").otherwise("spread")


def safe_label(c: Column | str) -> Column:
    """Anything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def safe_label_text(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_-" else "_" for ch in text)


def canonical_json(value: Any) -> str:
    return json.dumps(json_ready(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256_json(value: Any, without: tuple[str, ...] = ()) -> str:
    """Digest of the canonical form; top-level keys in ``without`` don't count."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def json_ready(value: Any) -> Any:
    """NaN and infinities become null, tuples lists."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_ready(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def parse_utc_ns(text: str) -> int:
    """ISO 8601 with ``Z`` or an offset, as nanoseconds."""
    if not re.search(r"(Z|[+-]\d\d:?\d\d)$", text):
        raise ValueError(f"a time needs Z or an offset: {text}")
    t = datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
    whole = int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() // 1)
    return whole * 1_000_000_000 + t.microsecond * 1000
