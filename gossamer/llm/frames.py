"""Pandas frames that Arrow converts even if they have no row."""

from __future__ import annotations

import pandas as pd


def frame(**columns) -> pd.DataFrame:
    """A frame of lists, arrays and series; lists become object columns, because an empty float column is no text or list column."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) if isinstance(values, list) else values for name, values in columns.items()})
