"""A bit filter of fixed size over 64-bit numbers, built by Spark and sent to every task.

It has one bit per slot, so it lets through everything that was put in and, by chance, some that
was not. It saves work and decides nothing: what passes is compared exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BITS = 26
_WORDS_PER_ROW = 1024


def slot_of(number: Column, bits: int = BITS) -> Column:
    return number.bitwiseAND(F.lit((1 << bits) - 1))


def bit_filter(numbers: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """2 ** bits bits as 64-bit words (8 MB for 26), whatever the number of rows."""
    slots = numbers.select(slot_of(F.col(column), bits).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(_WORDS_PER_ROW, np.int64)
        own[part["word"].to_numpy(np.int64) % _WORDS_PER_ROW] = part["bits"].to_numpy(np.int64)
        return pd.DataFrame({"row": [int(part["row"].iloc[0])], "bits": [own.tobytes()]})

    rows = words.withColumn("row", (F.col("word") / _WORDS_PER_ROW).cast("long")).groupBy("row").applyInPandas(pack, "row long, bits binary")
    found = np.zeros((max(1, (1 << (bits - 6)) // _WORDS_PER_ROW), _WORDS_PER_ROW), np.int64)
    for r in rows.collect():
        found[r.row] = np.frombuffer(r.bits, np.int64)
    return found.ravel()


def passes(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers.astype(np.int64) & (len(words) * 64 - 1)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1
