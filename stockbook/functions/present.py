"""Final projection used when a result is compared with another engine.

Money stays decimal inside every job; only this last step turns decimals into
doubles, timestamps into 'yyyy-MM-dd HH:mm:ss' text, dates into ISO text and
every integer width into bigint, so the values hash the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def for_compare(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, _INTS):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
