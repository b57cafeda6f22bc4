"""Durations such as ``15m``, ``4h`` or ``60d``, in whole microseconds."""

import re

_UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}

DAY_US = _UNIT_US["d"]


def duration_us(text: str) -> int:
    match = re.fullmatch(r"\s*(\d+)\s*(us|ms|min|s|m|h|d)\s*", text)
    if not match or int(match[1]) == 0:
        raise ValueError(f"not a duration: {text!r}")
    return int(match[1]) * _UNIT_US[match[2]]


def bucket_us(text: str) -> int:
    """A tumbling width. It has to divide a day, so that buckets line up with
    midnight whatever the first row of a ticker is."""
    width = duration_us(text)
    if DAY_US % width:
        raise ValueError(f"bucket width {text!r} does not divide a day")
    return width


def interval_sql(us: int) -> str:
    return f"{us} microseconds"
