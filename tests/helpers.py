from collections import Counter
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


class Bag(list):
    """Rows compared without regard to their order."""

    def __eq__(self, other):
        return Counter(self) == Counter(other)

    __hash__ = None


def rows(df, *cols):
    cols = cols or df.columns
    return Bag(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def counted(df):
    cols = sorted(df.columns)
    return Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
