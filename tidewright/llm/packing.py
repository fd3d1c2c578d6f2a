"""Texts into containers of fixed capacity (problem 8): minimum bin slack.

Only the lengths matter, and there are at most ``capacity`` different ones, so
the search runs on their histogram: take the largest length left, let a bitset
of reachable sums over the available lengths find the fullest completion, and
use that combination as often as the counts allow.  Each combination exhausts
a length, so the plan's size depends on the capacity and not on the corpus.

The plan is then applied to all texts at once: a text's rank among those of
its length, found shard by shard, says which container it goes to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bytebpe import VOCABULARY, count_tokens

#: Texts that one shard of one length holds about.
SHARD = 200_000


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    ``order`` holds the lengths that may be used, longest first.  Bit s of the
    bitset is set if some multiset sums to s; a length with c copies enters as
    binary parts 1, 2, 4, ... of it.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in order:
        if size > room:
            continue
        left, part = min(counts[size], room // size), 1
        while left:
            k = min(part, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left, part = left - k, part * 2
        if reach >> room & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> goal & 1:
            used[size] = used.get(size, 0) + k
            goal -= size * k
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, per container, first container, containers): which ranks of a length go where."""
    counts = {k: v for k, v in counts.items() if v > 0}
    order, taken, out, container = sorted(counts, reverse=True), dict.fromkeys(counts, 0), [], 0
    while order:
        big = order[0]
        counts[big] -= 1
        use = fullest(counts, [s for s in order if counts[s]], capacity - big)
        counts[big] += 1
        use[big] = use.get(big, 0) + 1
        times = min(counts[s] // k for s, k in use.items())
        for s, k in use.items():
            out.append((s, taken[s], k, container, times))
            taken[s] += k * times
            counts[s] -= k * times
        container += times
        order = [s for s in order if counts[s]]
    return out


class Places:
    """Where each rank of a length goes: plan rows (pack, length, first rank, per container, first container), searched in two steps."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        pack, size, self.rank, self.per, self.first = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()
        self.lengths = np.unique(self._length(pack, size))
        self.start = self._key(pack, size, self.rank)

    @staticmethod
    def _length(pack, size):
        return (pack << 48) | size

    def _key(self, pack, size, rank):
        # Less than 2^23 packs and lengths, less than 2^40 items of one.
        return (np.searchsorted(self.lengths, self._length(pack, size)) << 40) | rank

    def container(self, pack: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, self._key(pack, size, rank), "right") - 1
        return self.first[at] + (rank - self.rank[at]) // self.per[at]


def pack(sizes: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Put items (doc_id, n) into containers of every capacity of ``packs``.

    Gives (pack_name, container_id, doc_id, part, start_token, n_tokens).  An
    item longer than the capacity is cut into full containers and a rest; no
    other is cut.  An item of no length lies in container 0 and takes no room.
    Every item appears, equal and null ids included.
    """
    spark = sizes.sparkSession
    names = sorted(k for k, c in packs.items() if k is not None and c is not None and c > 0)
    out = "pack_name string, container_id bigint, doc_id bigint, part bigint, start_token bigint, n_tokens bigint"
    if not names:
        return spark.createDataFrame([], out)
    sized = sizes.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    options = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(int(packs[k])).cast("bigint").alias("c")) for i, k in enumerate(names)])
    items = sized.select("doc_id", "n", F.explode(options).alias("o")).select("doc_id", "n", "o.p", "o.c")
    items = items.select("doc_id", "n", "p", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(n - 1) div c"), F.lit(0).cast("bigint")))).alias("part"))
    items = items.select("doc_id", "p", "part", (F.col("part") * F.col("c")).alias("start"), F.least("c", F.col("n") - F.col("part") * F.col("c")).alias("len"))

    # At most the sum of the capacities: one row per capacity and length.
    hist = items.where("len > 0").groupBy("p", "len").count().collect()
    shards = max(1, max((r["count"] for r in hist), default=1) // SHARD + 1)
    rows = []
    for i, k in enumerate(names):
        for s, rank, per, first, times in plan({r["len"]: r["count"] for r in hist if r["p"] == i}, packs[k]):
            rows.append((i, s, rank, per, first))
    table = spark.sparkContext.broadcast(Places(rows))

    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    empty = items.where("len = 0").select(F.element_at(F.array(*map(F.lit, names)), F.col("p") + 1).alias("pack_name"), F.lit(0).cast("bigint").alias("container_id"), "doc_id", "part", F.col("start").alias("start_token"), F.col("len").alias("n_tokens"))
    items = items.where("len > 0").withColumn("s", shard)
    within = Window.partitionBy("p", "len", "s").orderBy("doc_id", "part")
    ranked = items.withColumn("r", F.row_number().over(within) - 1)
    if shards > 1:
        before = items.groupBy("p", "len", "s").count()
        before = before.withColumn("off", F.sum("count").over(Window.partitionBy("p", "len").orderBy("s")) - F.col("count")).drop("count")
        ranked = ranked.join(before, ["p", "len", "s"]).withColumn("r", F.col("r") + F.col("off"))

    def place(batches):
        for b in batches:
            p, size, r = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 4, 5))
            label = pa.array(np.array(names, object)[p], pa.string())
            yield pa.RecordBatch.from_arrays([label, pa.array(table.value.container(p, size, r)), b.column(0), b.column(2), b.column(3), b.column(4)], names=[x.split()[0] for x in out.split(", ")])

    return ranked.select("doc_id", F.col("p").cast("bigint"), "part", "start", "len", F.col("r").cast("bigint")).mapInArrow(place, out).unionByName(empty)


def pack_texts(docs: DataFrame, pack_sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack whole texts, measured in tokens; ``pack_sizes`` (pack_name, capacity) is a short list of parameters."""
    packs = {r["pack_name"]: r["capacity"] for r in pack_sizes.select("pack_name", "capacity").collect()}
    sizes = materialize(count_tokens(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), vocabulary=vocabulary), "sizes")
    return pack(sizes, packs)
