"""Bring entries of a table of any size to the rows whose texts mention them.

A table of at most ``most`` entries is collected (one row more than that is read at most) and broadcast. A larger one is
joined: each row sends those of its keys that a bitmap of fixed size does not rule out, and takes the entries found along
in a column. Both ways give a worker the same entries, so results do not depend on the size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Some 20 MB as Python strings.
MOST = 200_000
ENTRIES = "_entries"
# The bitmap of a joined table's keys: 4 MB, in pieces of 8 KB.
BITS = 25
PIECE = 16


def places(keys: Iterable[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys), dtype=np.int64)


def key_bitmap(entries: DataFrame) -> np.ndarray:
    """One bit per hash of a key; at most ``2**(BITS - PIECE)`` pieces come to the driver, whatever the table's size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            seen[places(b.column("key").to_pylist())] = True
        at = np.flatnonzero(seen.reshape(-1, 1 << PIECE).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.packbits(seen[i << PIECE : (i + 1) << PIECE]).tobytes() for i in at.tolist()], pa.binary())], names=["piece", "bits"])

    def either(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(1 << PIECE >> 3, dtype=np.uint8)
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((1 << (BITS - PIECE), 1 << PIECE >> 3), dtype=np.uint8)
    for r in entries.select("key").mapInArrow(bits, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def deliver(rows: DataFrame, text: str, entries: DataFrame, keys_of: Callable[[str], Iterable[str]], most: int = MOST) -> tuple[DataFrame, Callable[[pa.RecordBatch], dict[str, str]]]:
    """``rows`` with a column ``_entries``, and a function from a batch of them to the entries ``{key: value}`` it needs.

    ``entries(key string, value string)`` has one row per key; ``keys_of`` gives all keys that a text may look up. Rows of
    equal texts share one key, so keys are sent once per distinct text of a task; a hot text or word is a hot key of a
    join only, which the planner splits."""
    entries = entries.select("key", "value")
    few = entries.limit(most + 1).collect()
    if len(few) <= most:
        shared = rows.sparkSession.sparkContext.broadcast({r["key"]: r["value"] for r in few})
        return rows.withColumn(ENTRIES, F.lit(None).cast("array<struct<key:string,value:string>>")), lambda b: shared.value
    bitmap = rows.sparkSession.sparkContext.broadcast(np.packbits(key_bitmap(entries)))
    keyed = rows.withColumn("_text_key", F.xxhash64(text))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, out, seen, known = [], [], set(), np.unpackbits(bitmap.value).astype(bool)
            for k, t in zip(b.column("_text_key").to_pylist(), b.column("text").to_pylist()):
                if t and k not in seen:
                    seen.add(k)
                    got = list(set(keys_of(t)))
                    got = [x for x, ok in zip(got, known[places(got)]) if ok]
                    owners += [k] * len(got)
                    out += got
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(out, pa.string())], names=["_text_key", "key"])

    held = keyed.select("_text_key", F.col(text).alias("text")).mapInArrow(keys, "_text_key bigint, key string").distinct().join(entries, "key")
    per = held.groupBy("_text_key").agg(F.collect_list(F.struct("key", "value")).alias(ENTRIES))

    def of_batch(b: pa.RecordBatch) -> dict[str, str]:
        return {r["key"]: r["value"] for rs in b.column(ENTRIES).to_pylist() for r in rs or ()}

    return keyed.join(per, "_text_key", "left").drop("_text_key"), of_batch
