"""Fixed-size bitmaps that thin rows before a shuffle. They never decide: a join follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize

#: 2^23 bits: 1 MB in every task, at any input size. A full bitmap thins nothing and loses nothing.
BITS = 23


def bitmap(df: DataFrame, hashed: str) -> np.ndarray:
    """Bits of a column of 64-bit hashes; at most 2^17 words reach the driver."""
    slot = F.shiftrightunsigned(hashed, 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = df.select(F.shiftright(slot, 6).alias("w"), bit.alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[table["w"].to_numpy()] = table["b"].to_numpy()
    return bits


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each 64-bit hash, whether its bit is set."""
    slot = (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def thinned(df: DataFrame, hashed: str, bits: np.ndarray, inverse: bool = False) -> DataFrame:
    """The rows whose hash has its bit set, or with ``inverse`` those that surely lack it.

    The test is passed on as not deterministic: else Spark infers it for the other sides of later joins, where it
    drops nothing and holds a second Python worker in each task.
    """

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        return pa.array(has(bits, hashes.to_numpy(zero_copy_only=False)) != inverse)

    return df.filter(held.asNondeterministic()(hashed))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``dropped`` (doc_id). Only rows that may go are shuffled."""
    dropped = materialize(dropped)
    spare = next(name for n in range(len(docs.columns) + 1) if (name := f"_h{n}") not in docs.columns)
    marked = docs.withColumn(spare, F.xxhash64("doc_id"))
    bits = bitmap(dropped.select(F.xxhash64("doc_id").alias("h")), "h")
    sure = thinned(marked, spare, bits, inverse=True).drop(spare)
    rest = thinned(marked, spare, bits).drop(spare)
    return sure.union(rest.join(dropped, rest["doc_id"].eqNullSafe(dropped["doc_id"]), "left_anti"))
