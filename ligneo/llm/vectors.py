"""What the operators on embeddings share: the vectors that take part."""

from pyspark.sql import functions as F


def usable(column="embedding"):
    """Condition: not null, not empty, every component finite, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
