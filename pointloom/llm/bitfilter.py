"""A broadcast bit filter of bounded size: it may let too much through, never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits at least and at most (16 MB), whatever the number of values.
BITS = 1 << 16, 1 << 27


class BitFilter:
    """Holds two bits for each 64-bit value of a column; test() is true for all of these and few others."""

    def __init__(self, values: DataFrame, expected: int):
        """values: one long column. expected: about how many; only the filter's size follows from it."""
        spark = values.sparkSession
        (name,) = values.columns
        self.bits = bits = min(BITS[1], max(BITS[0], 1 << (16 * max(1, expected)).bit_length()))
        g = F.col(name)
        probes = values.select(F.explode(F.array(g.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(g, 33).bitwiseAND(F.lit(bits - 1)))).alias("p"))
        # at most bits / 64 rows come back, whatever the number of values
        cells = probes.groupBy(F.expr("p div 64").alias("c")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
        flat = np.zeros(bits // 64, dtype=np.int64)
        flat[cells.column("c").to_numpy()] = cells.column("v").to_numpy()
        self.held = spark.sparkContext.broadcast(flat.view(np.uint64))

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "held": self.held}

    def test(self, g: np.ndarray) -> np.ndarray:
        f, m = self.held.value, np.uint64(self.bits - 1)
        ok = np.ones(len(g), dtype=bool)
        for p in (g & m, (g >> np.uint64(33)) & m):
            ok &= (f[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok
