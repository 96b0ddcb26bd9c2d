"""Small helpers for functions that run on one group."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd


def put_keys(out: pd.DataFrame, names: Sequence[str], key: tuple) -> pd.DataFrame:
    """Put the group's key values in front of its output; keeps text columns text when empty."""
    for at, (name, v) in enumerate(zip(names, key)):
        dtype = object if isinstance(v, str) else None
        out.insert(at, name, pd.Series([v] * len(out), index=out.index, dtype=dtype))
    return out
