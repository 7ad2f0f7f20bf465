"""Column contracts and fixed values of the customer-journey data model."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Markers of a missing answer.
MISSING = ("--", "-", "", "NA", "N/A", "null", "None")

# Touchpoint codes, with gaps at 11 and 17.
TOUCH_CODES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 18, 19, 20, 21, 22)

#: Columns of the click log after ingestion: `ord` is the row's place in its file, the tie-breaker of every order.
CLICKS = {"user_id": "bigint", "ts": "timestamp", "touch": "int", "duration": "double", "ord": "bigint"}


class ContractError(ValueError):
    """A table lacks columns that an operator needs."""


def require(df: DataFrame, *columns: str, what: str = "the table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} lacks {', '.join(missing)}")
    return df
