"""Bounded memory: the most important items per owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.history import joined
from tallyloom.operators.ranking import top_n_per_key

MAX_ITEMS = 5


def strongest(items: DataFrame, owner: str, importance: str, seq: str, n: int = MAX_ITEMS) -> DataFrame:
    """What is left after adding items in `seq` order and keeping the n most important; earlier wins ties."""
    return top_n_per_key(items, [owner], [F.desc(importance), F.asc(seq)], n, rank="place")


def memory_text(items: DataFrame, owner: str, importance: str, seq: str, text: str, n: int = MAX_ITEMS) -> DataFrame:
    """One text per owner: its n strongest items, one per line."""
    return joined(strongest(items, owner, importance, seq, n), [owner], text, "place", "\n", "memories")
