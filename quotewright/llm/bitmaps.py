"""Fixed-size bitmaps of key sets, to thin a large side before it is shuffled.

A bitmap has a set number of bits whatever the input, so it may be collected and broadcast.  Bits
may collide, so a join decides afterwards; a bitmap that fills up lets everything through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BITS = 1 << 23


def _spot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)


def _bitmaps(keys: DataFrame, levels: int, bits: int) -> list[Broadcast]:
    """A bitmap for each level of ``keys`` (a long key, its level from 1 on): level k holds the keys of level k and up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            key, level = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k in range(1, levels + 1):
                if (level >= k).any():
                    at = np.unique(_spot(key[level >= k], bits))
                    own = seen.setdefault(k, np.zeros(bits // 8, np.uint8))
                    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for k, own in seen.items():
            pages = own.reshape(-1, min(4096, len(own)))
            used = np.flatnonzero(pages.any(1))
            for i in range(0, len(used), 256):
                part = used[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)), pa.array([pages[p].tobytes() for p in part], pa.binary())], names=["level", "page", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for level, page, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(x, np.uint8)
                whole[level, page] = x if (level, page) not in whole else whole[level, page] | x
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in whole], pa.int32()), pa.array([p for _, p in whole], pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], names=["level", "page", "bits"])

    schema = "level int, page int, bits binary"
    pages = keys.mapInArrow(tidy(partial), schema).repartition("level", "page").mapInArrow(tidy(merged), schema).collect()  # levels * bits / 8 bytes at most
    out = [np.zeros(bits // 8, np.uint8) for _ in range(levels)]
    width = min(4096, bits // 8)
    for r in pages:
        out[r.level - 1][r.page * width : (r.page + 1) * width] |= np.frombuffer(r.bits, np.uint8)
    sc = keys.sparkSession.sparkContext
    return [sc.broadcast(x) for x in out]


def bitmap(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """Broadcast bitmap of the one long column of ``keys``; ``bits`` is a power of two."""
    return _bitmaps(keys.select(keys.columns[0], F.lit(1).alias("level")), 1, bits)[0]


def may_hold(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key False if the bitmap rules it out."""
    at = _spot(keys, len(seen) * 8)
    return (seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _by_bitmap(rows: DataFrame, key: str, held: Broadcast, wanted: bool) -> DataFrame:
    place = rows.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            maybe = may_hold(held.value, pc.fill_null(column, 0).to_numpy(zero_copy_only=False)) | column.is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(maybe == wanted))

    return rows.mapInArrow(tidy(keep), rows.schema)


def likely(rows: DataFrame, key: str, held: Broadcast) -> DataFrame:
    """``rows`` without those whose long column ``key`` the bitmap rules out (null: kept)."""
    return _by_bitmap(rows, key, held, True)


def unlikely(rows: DataFrame, key: str, held: Broadcast) -> DataFrame:
    """The rows that ``likely`` leaves out."""
    return _by_bitmap(rows, key, held, False)


#: A key with ``HOT`` x ``FAN``**k rows is dealt over ``FAN``**(k+1) salts, up to ``LEVELS`` times.
HOT, FAN, LEVELS = 128, 16, 6


def hot_keys(counts: DataFrame) -> list[Broadcast]:
    """Bitmaps of the keys of ``counts`` (a long key, its number of rows) over each level's bound."""
    key, n = counts.columns
    most = counts.agg(F.max(n)).first()[0] or 0
    levels = sum(most > HOT * FAN**k for k in range(LEVELS))
    if not levels:
        return []
    level = sum(((F.col(n) > HOT * FAN**k).cast("int") for k in range(levels)), F.lit(0))
    return _bitmaps(counts.where(F.col(n) > HOT).select(key, level.alias("level")), levels, BITS)


def _salted(rows: DataFrame, key: str, hot: list[Broadcast]) -> DataFrame:
    """``rows`` with ``salts``, the number of salts of its key: the same for equal keys, whatever the table."""
    place = rows.columns.index(key)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(place).to_numpy(zero_copy_only=False)
            level = np.zeros(len(keys), np.int64)
            for h in hot:
                level += may_hold(h.value, keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(FAN**level)], names=[*b.schema.names, "salts"])

    return rows.mapInArrow(tidy(add), rows.select("*", F.lit(0).cast("long").alias("salts")).schema)


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: list[Broadcast], spread: list[str], how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """``rows`` join ``table`` on the long ``key`` (never null) and ``also``; hot keys are dealt by a hash of the columns ``spread``."""
    if not hot:
        return rows.join(table, [key, *also], how)
    left = _salted(rows, key, hot).withColumn("salt", F.pmod(F.xxhash64(*spread), F.col("salts"))).drop("salts")
    right = _salted(table, key, hot).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return left.join(right, [key, *also, "salt"], how).drop("salt")
