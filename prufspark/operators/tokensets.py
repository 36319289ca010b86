"""Which token sets of a whole table are similar?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prufspark.plans.lineage import cut

PART = 4_096  # Sets of one token that meet at once; a more frequent one is split.
HELD, HELD_BYTES = 65_536, 1 << 26  # Sets that a task reads, and their bytes, before it pairs those of whole groups.
ROWS, MET = 1_024, 1 << 18  # Sets compared with their partners at once, pairs of these.
CELLS, TOKENS = 1 << 25, 1 << 20  # Cells of their table of tokens, tokens looked up in it at once.
PER_TASK = 1 << 26  # Pairs of sets of one group, before any filter, that a task is to have.


def similar_token_sets(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(a, b)`` of ``rows(key, toks)``, toks distinct, a before b, over the whole table. Equal sets are one class until the end: pairs
    are sought between classes, and their members paired last. Rows without key or tokens have no pair."""
    # Filtered once it is written: a filter before would build every token array twice.
    rows = cut(rows.select(key, F.sort_array("toks").alias("toks"))).where(F.col(key).isNotNull() & (F.size("toks") > 0))
    classes = cut(rows.groupBy("toks").agg(F.count("*").alias("many")).withColumn("set", F.monotonically_increasing_id()))
    members = cut(rows.join(classes, "toks").select("set", key))
    near = similar_classes(classes, threshold).unionByName(classes.where("many > 1").select(F.col("set").alias("a"), F.col("set").alias("b")))
    one, two = (members.select(F.col("set").alias(c), F.col(key).alias(f"key_{c}")) for c in "ab")
    pairs = near.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("key_a") < F.col("key_b")))
    return pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, each pair once in either order, of the different ``sets(set, toks)`` whose similarity reaches the threshold.

    Tokens are numbered from rare to frequent. Two similar sets share their first common token in the prefix of both, so
    sets meet in the groups of the tokens of their prefixes; a token of many sets has a group for each two parts of them.
    Only the group of the first common token gives the pair, so pairs are neither collected nor made distinct."""
    words = sets.select("set", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    known = cut(words.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1").orderBy("df", "tok").select("tok", F.monotonically_increasing_id().alias("id")))
    # Tokens of one set only have no number; they still take the first places of the prefix.
    held = words.join(known, "tok").groupBy("set", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = cut(held.withColumn("prefix", F.size("ids") - F.ceil(threshold * F.col("n") - 1e-9) + 1).where("prefix > 0"))
    met = held.select("set", "n", "ids", F.explode(F.slice("ids", F.lit(1), F.col("prefix").cast("int"))).alias("id"))

    sizes = cut(met.groupBy("id").agg(F.count("*").alias("many")).where("many > 1"))
    tasks = sizes.agg(F.ceil(F.sum(F.col("many") * F.col("many")) / (2 * PER_TASK))).first()[0] or 0
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tasks))
    hot = F.broadcast(sizes.where(F.col("many") > PART).select("id", F.ceil(F.col("many") / PART).alias("parts")))
    met = met.join(hot, "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    group = ["id", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side")]
    met = met.select(*group, "n", "set", "ids").repartition(tasks, "id", "low", "high").sortWithinPartitions("id", "low", "high", "side", "n")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= HELD or sum(x.nbytes for x in held) >= HELD_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                ends = np.flatnonzero(_changes(t)[1:]) + 1
                if len(ends):
                    yield from _similar(t.slice(0, int(ends[-1])), threshold)
                    t = t.slice(int(ends[-1]))
                held = t.to_batches()
        if held:
            yield from _similar(pa.Table.from_batches(held).combine_chunks(), threshold)

    return met.mapInArrow(pair, "a bigint, b bigint")


def _changes(t: pa.Table) -> np.ndarray:
    """Whether a row begins another group than the row before."""
    new = np.ones(len(t), bool)
    new[1:] = False
    for c in ("id", "low", "high"):
        x = t[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def _similar(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups, ordered by side and size in each, that have the group's token as their first common one."""
    group, side, n, name = np.cumsum(_changes(t)), t["side"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64), t["set"].to_numpy()
    lists = pa.concat_arrays(t["ids"].chunks)
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    start, count = ends[:-1], np.diff(ends)
    ids, toks = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    own = np.searchsorted(ids, t["id"].to_numpy())

    # A bit for each token, flipped by all that fall on it: two sets differ in at least as many tokens as bits.
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros((len(ids), 2), np.uint64)
    bits[np.arange(len(ids)), (mixed >> np.uint64(63)).astype(np.int64)] = np.uint64(1) << (mixed >> np.uint64(57) & np.uint64(63))
    bits = np.ascontiguousarray(np.bitwise_xor.reduceat(bits[toks], start).T)

    # Partners follow by size: those after a set in its part, or those of the other part.
    most = int(n.max()) + 1
    at = (group * 2 + side) * most + n
    crossed = (t["low"].to_numpy() != t["high"].to_numpy()).astype(np.int64)
    top = (group * 2 + crossed) * most
    low = np.where(crossed == 1, np.searchsorted(at, top + np.ceil(threshold * n - 1e-9).astype(np.int64)), np.arange(len(n)) + 1)
    high = np.searchsorted(at, top + np.minimum(np.floor(n / threshold + 1e-9).astype(np.int64), most - 1), "right")
    met = np.where(side == 1, 0, np.maximum(high - low, 0))

    slack = (1 + threshold) * count - 2 * threshold * n
    left = np.flatnonzero(met)
    done = np.cumsum(met[left])
    rows = min(ROWS, max(1, CELLS // len(ids)))
    has = np.zeros((rows, len(ids)), bool)
    k = 0
    while k < len(left):
        some = left[k : max(k + 1, min(k + rows, int(np.searchsorted(done, (done[k - 1] if k else 0) + MET, "right"))))]
        k += len(some)
        r, j = np.repeat(np.arange(len(some)), met[some]), _ranges(low[some], met[some])
        i = some[r]
        apart = np.bitwise_count(bits[0][i] ^ bits[0][j]) + np.bitwise_count(bits[1][i] ^ bits[1][j])
        near = np.flatnonzero(slack[i] + slack[j] - (1 + threshold) * apart >= -1e-6)
        cells = np.repeat(np.arange(len(some)), count[some]), toks[_ranges(start[some], count[some])]
        has[cells] = True
        for part in np.array_split(near, 1 + int(count[j[near]].sum()) // TOKENS) if len(near) else []:
            x, y = i[part], j[part]
            theirs = toks[_ranges(start[y], count[y])]
            hit = has[np.repeat(r[part], count[y]), theirs]
            begins = np.cumsum(count[y]) - count[y]
            common = np.add.reduceat(hit, begins, dtype=np.int64)
            least = np.minimum.reduceat(np.where(hit, theirs, len(ids)), begins)
            good = (least == own[x]) & (common / (n[x] + n[y] - common) >= threshold - 1e-12)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(name[x[good]]), pa.array(name[y[good]])], names=["a", "b"])
        has[cells] = False
