"""Column functions of the article model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col
