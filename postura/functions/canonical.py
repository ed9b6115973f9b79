"""One form for equal JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """The JSON text with its objects' names in order, at every depth, and no space between; null if it is no JSON or repeats a name.

    VARIANT keeps an object's fields by name, so that writing it is all there is to do, at any
    depth. Decimals lose trailing zeros (1.50 is 1.5, 2.0 is 2), other numbers become doubles;
    control characters are escaped, other ones stand as they are. Lists keep their order.
    """
    return F.to_json(F.try_parse_json(text))
