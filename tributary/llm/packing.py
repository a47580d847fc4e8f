"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.bpe import slice_ids, vocabulary
from tributary.llm.runtime import map_batches, ship, slices, table

#: Pieces that one packer places one after the other. A packer leaves a few sequences unfilled, whatever it places.
SHARD_PIECES = 4096


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): each text's ids and end_id, cut only where longer than size.

    The first piece takes what is left over when the others are full, so a text has at most one piece that isn't full.
    Null and empty texts are the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "t"):
                flat, ends = slice_ids(part, "t", bpe)
                rows: list[tuple] = []
                at = 0
                for key_, to in zip(part.column(0).to_pylist(), ends):
                    own = np.append(flat[at:to], end)
                    at = to
                    n = len(own)
                    first = n % size or size
                    starts = [0, *range(first, n, size)]
                    for i, a in enumerate(starts):
                        ids = own[a : starts[i + 1] if i + 1 < len(starts) else n].tobytes()
                        rows.append((key_, i, a, len(ids) >> 2, zlib.crc32(ids), ids))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["k", "piece", "start", "length", "ids_crc32", "ids"])

    out = map_batches(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), cut, "k long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out.withColumnRenamed("k", key)


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, longest first, each put into the open bin that makes the sum over gaps g in
    1..size-1 of squared counts of open bins with gap g smallest; among equals the one with the smallest gap, and of those the
    last opened or filled. A new bin is opened only where no open one has room: with few items the rule's own choice of new ones costs bins."""
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(size + 1, np.int64)  # open bins by gap; a full bin and an empty one cost nothing
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order:
        s = int(lengths[i])
        gaps = s + np.flatnonzero(count[s:size])
        if len(gaps):
            left = gaps - s
            change = 2 - 2 * count[gaps] + np.where(left > 0, 2 * count[left], -1)
            best = int(gaps[np.argmin(change)])
            b = open_[best].pop()
            count[best] -= 1
        else:
            b = len(fill)
            fill.append(0)
            best = size
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if best > s:
            count[best - s] += 1
            open_[best - s].append(b)
    return bins, offsets


def pack(parts: DataFrame, size: int = 2048, length: str = "length") -> DataFrame:
    """parts with sequence_id and offset: its rows packed into sequences of at most size, each gapless from 0.

    Rows are dealt to packers of about SHARD_PIECES by a hash, so no packer grows with the input. What lies in sequences that
    they leave unfilled is dealt out and packed once more. parts should be a written table, as it is counted first; the packed
    rows are written before they are split. A length below 1, above size or null raises. An empty table stays empty; equal rows
    are packed each. Other columns may have any names but sequence_id and offset.
    """
    if {"sequence_id", "offset"} & set(parts.columns):
        raise ValueError("sequence_id and offset are names of this operator")
    ship(parts.sparkSession)
    names = [f"c{i}" for i in range(len(parts.columns))]
    own = parts.toDF(*names)
    n = names[parts.columns.index(length)]
    keys = [names[parts.columns.index(c)] for c in ("doc_id", "piece") if c in parts.columns] or [n]

    def packed(rows: DataFrame, salt: int, base: int) -> DataFrame:
        shards = max(1, round(rows.count() / SHARD_PIECES))

        def placed(shard: pd.DataFrame) -> pd.DataFrame:
            shard = shard.sort_values(keys, kind="stable")
            lengths = shard[n].to_numpy()
            if shard[n].isna().any() or lengths.min() < 1 or lengths.max() > size:
                raise ValueError("a length is out of range")
            bins, offsets = place(lengths.astype(np.int64), size)
            full = np.bincount(bins, lengths)[bins] == size
            return shard.assign(sequence=((base + shard["shard"].to_numpy().astype(np.int64)) << 32) + bins, at=offsets, full=full)[[*names, "sequence", "at", "full"]]

        schema = T.StructType([*own.schema.fields, *(T.StructField(c, k) for c, k in (("sequence", T.LongType()), ("at", T.LongType()), ("full", T.BooleanType())))])
        return rows.withColumn("shard", F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(placed, schema)

    first = table(packed(own, 0, 0))
    out = first.where("full").unionByName(packed(first.where("not full").select(*names), 1, 1 << 30)).drop("full")
    return out.toDF(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(table(pieces(docs, path, size, end_id).drop("ids")), size)
