"""What several test modules use."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    """Rows as sorted tuples, nulls first, for comparison whatever the order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
