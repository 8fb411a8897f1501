"""Scalar functions: masking of long digit runs, and XXH64."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "PII_REDACTED_"
_DIGITS = re.compile("[0-9]{12}")
#: The primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_of_12(data: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of rows of 12 bytes."""
    rows = np.ascontiguousarray(data, np.uint8).reshape(-1, 12)
    lane, tail = rows[:, :8].copy().view("<u8").ravel(), rows[:, 8:].copy().view("<u4").ravel().astype(np.uint64)
    h = np.full(len(rows), _P5 + np.uint64(12), np.uint64)
    h = _rotl(h ^ (_rotl(lane * _P2, 31) * _P1), 27) * _P1 + _P4
    h = _rotl(h ^ (tail * _P1), 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_of_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit numbers, as Spark's xxhash64 reckons it (with seed 42), unsigned."""
    h = np.full(len(values), np.uint64(seed) + _P5 + np.uint64(8), np.uint64) ^ (_rotl(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def mask_text(text: str | None) -> str | None:
    """Each leftmost run of 12 ASCII digits becomes the mark and the run's hash in hex; a 13th digit stays."""
    if text is None or not (found := _DIGITS.findall(text)):
        return text
    hashes = iter(xxh64_of_12(np.frombuffer("".join(found).encode(), np.uint8)))
    return _DIGITS.sub(lambda _: f"{MARK}{int(next(hashes)):016x}", text)


@F.pandas_udf(StringType())
def mask_pii(text: pd.Series) -> pd.Series:
    return text.map(mask_text, na_action="ignore")


def pii_mark(text: Column | str) -> Column:
    """The masked text without the hashes, in the JVM: enough to find and count what is masked."""
    return F.regexp_replace(text, "[0-9]{12}", MARK)


def pii_runs(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[0-9]{12}")), F.lit(0))


def rfc3339_nanos(text: Column | str) -> Column:
    """RFC 3339 times to nanoseconds since 1970, all nine digits kept; null for other texts."""
    pattern = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)$"
    zone = F.when(F.upper(F.regexp_extract(text, pattern, 4)) == "Z", "+00:00").otherwise(F.regexp_extract(text, pattern, 4))
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(text, pattern, 1), F.lit(" "), F.regexp_extract(text, pattern, 2), zone)))
    return F.when(F.rlike(text, F.lit(pattern)), seconds * 1_000_000_000 + F.rpad(F.regexp_extract(text, pattern, 3), 9, "0").cast("long"))
