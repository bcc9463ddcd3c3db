"""Canonical JSON digests: sha256 of a JSON text with sorted keys and compact separators."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _one(text: str | None) -> str | None:
    if text is None:
        return None

    def refuse(name: str):
        raise ValueError(f"{name} has no canonical form")

    value = json.loads(text, parse_constant=refuse)
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _all(text: pd.Series) -> pd.Series:
    return text.map(_one)


def canonical_digest(text: Column) -> Column:
    """The digest of each JSON text; null stays null, NaN and infinities are errors."""
    return F.pandas_udf(_all, "string")(text)
