"""Guards on what may enter a computation: panels, look-ahead columns, labels, forbidden keys, sealed sessions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_single_panel(df: DataFrame, panel: str = "panel", what: str = "this aggregate") -> DataFrame:
    """``df`` itself if its rows are of one panel; two different ones are enough to refuse."""
    seen = df.select(panel).where(F.col(panel).isNotNull()).distinct().limit(2).collect()
    if len(seen) > 1:
        raise ValueError(f"{what} would mix panels {sorted(str(r[0]) for r in seen)}")
    return df


def input_columns(df: DataFrame, keys: Iterable[str], labels: Iterable[str], ahead: Iterable[str] = ()) -> list[str]:
    """Columns that may be inputs: neither keys nor labels nor look-ahead flags, in the table's order."""
    barred = {*keys, *labels, *ahead}
    return [c for c in df.columns if c not in barred]


def assert_pit(columns: Sequence[str], labels: Iterable[str], ahead: Iterable[str] = (), prefixes: Sequence[str] = ("fwd_", "label_", "y_")) -> None:
    """Refuse labels and columns that look ahead, by name or prefix, as inputs."""
    barred = {*labels, *ahead}
    found = sorted(c for c in columns if c in barred or c.lower().startswith(tuple(prefixes)))
    if found:
        raise ValueError(f"not known at the time: {found}")


def guard_forbidden_keys(value: object, forbidden: Iterable[str], path: str = "") -> None:
    """Refuse a nested value that holds one of the keys at any depth; the message names its path."""
    barred = set(forbidden)
    items = value.items() if isinstance(value, Mapping) else enumerate(value) if isinstance(value, (list, tuple)) else ()
    for key, inner in items:
        here = f"{path}.{key}" if path else str(key)
        if isinstance(value, Mapping) and key in barred:
            raise ValueError(f"forbidden key {here}")
        guard_forbidden_keys(inner, barred, here)


def check_sessions(wanted: DataFrame, ledger: DataFrame, date: str = "day", status: str = "status") -> DataFrame:
    """``wanted`` itself if each of its sessions is in the ledger and open; sealed and unknown ones are refused."""
    open_ = ledger.where(F.col(status) == "OPEN").select(date)
    bad = wanted.select(date).distinct().join(open_, date, "left_anti").orderBy(date).limit(5).collect()
    if bad:
        raise ValueError(f"sealed or unknown sessions: {[str(r[0]) for r in bad]}")
    return wanted
