"""URL helpers as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_slash(url: Column) -> Column:
    return F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/")))


def join_url(base: Column, sub: Column | str, https: bool = True) -> Column:
    """`base`/`sub`, with a scheme added when `base` has none."""
    scheme = F.lit("https://" if https else "http://")
    full = F.when(F.startswith(base, F.lit("http://")) | F.startswith(base, F.lit("https://")), base).otherwise(
        F.concat(scheme, base)
    )
    return F.concat(with_slash(full), F.lit(sub) if isinstance(sub, str) else sub)


def path_part(url: Column, from_end: int) -> Column:
    """Slash-separated part counted from the end; 1 is what follows the last slash. Null when there are fewer."""
    return F.try_element_at(F.split(url, "/", -1), F.lit(-from_end))
