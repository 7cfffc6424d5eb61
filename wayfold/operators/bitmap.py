"""A filter of fixed size for the keys of a table: rows that can't have a partner are dropped before a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of a filter, whatever the input: 8 MB.  With more keys it lets more rows through, never fewer.
BITS = 1 << 26
#: Bits of one value of Spark's bitmap functions.
BUCKET = 32768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


class KeyFilter:
    """Tells which keys may be in a column; built by an aggregate, so the driver gets the bits and no keys."""

    def __init__(self, rows: DataFrame, key: str):
        place = _place(F.col(key))
        parts = rows.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toArrow()
        bits = np.zeros(BITS // 8, np.uint8)
        for b, m in zip(parts["b"].to_pylist(), parts["m"].to_pylist(), strict=True):
            bits[(b - 1) * BUCKET // 8 : b * BUCKET // 8] = np.frombuffer(m, np.uint8)
        self.sent = rows.sparkSession.sparkContext.broadcast(bits)

    def may_have(self, key: Column) -> Column:
        """False only for keys that are not in the column, and for null."""
        sent = self.sent

        @F.pandas_udf(BooleanType())
        def test(place: pd.Series) -> pd.Series:
            p = place.to_numpy(np.int64) - 1
            return pd.Series((sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

        return key.isNotNull() & test(F.coalesce(_place(key), F.lit(1)))
