"""The dimension of named system constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Identifier patterns and the constant type each stands for; first match wins.
CONST_PATTERNS = [
    ("socket_type", r"sock_type_(.*)"),
    ("socket_family", r"(AF_.*)"),
    ("family_protocol", r"(IPPROTO_.*)"),
]


def build_consts(identifiers: DataFrame, name: str = "identifier", value: str = "value") -> DataFrame:
    """Identifier/value rows → ``const_type, const_name, value``; other identifiers are dropped."""
    col = F.col(name)
    kind = F.coalesce(*[F.when(col.rlike(p), F.lit(t)) for t, p in CONST_PATTERNS])
    label = F.coalesce(*[F.when(col.rlike(p), F.regexp_extract(col, p, 1)) for _, p in CONST_PATTERNS])
    return identifiers.select(
        kind.alias("const_type"), label.alias("const_name"), F.col(value).cast("bigint").alias("value")
    ).filter(F.col("const_type").isNotNull())
