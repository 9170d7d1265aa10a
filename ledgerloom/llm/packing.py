"""Problem 8: filling fixed-capacity containers, tier by tier over the lengths of items.

Items are routed to tiers of halved context sizes by their length. Each tier is packed in turn, from the longest: its own items open
containers, longest first, and the gap that is left is filled from the shorter tiers, with the longest item that fits. The plan is
made on the histogram of lengths, which has at most as many rows as a container has tokens, however many items there are: it says how often each
filling pattern is used. Every item then finds its container from its place among the items of its
length. Containers are dealt to step groups in turn by cost, so that groups cost about the same.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import TOKENIZER, token_counts

#: Containers in a step group.
STEP = 16
TIERS = 5


def tier(length: int, capacity: int) -> int:
    """0 for more than half of the capacity, 1 for more than a quarter, and so on."""
    return min(TIERS - 1, max(0, (capacity // max(1, length)).bit_length() - 1))


def patterns(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(tier, times, [(length, items of it in a container)]): how the items of a length histogram fill containers, tier by tier.

    Every pattern is repeated until one of its lengths runs out, so there are no more patterns than
    lengths.
    """
    left = {n: c for n, c in lengths.items() if 0 < n <= capacity and c > 0}
    routed: list[list[int]] = [[] for _ in range(TIERS)]
    for n in sorted(left):
        routed[tier(n, capacity)].append(n)
    made = []
    for t, own in enumerate(routed):
        while own:
            free, use = capacity, []
            # the tier's own items first, then its gap from the shorter tiers
            for lane in routed[t:]:
                at = bisect_right(lane, free) - 1
                while at >= 0:
                    n = lane[at]
                    k = min(free // n, left[n])
                    if k:
                        use.append((n, k))
                        free -= k * n
                    at = min(at, bisect_right(lane, free)) - 1
            times = min(left[n] // k for n, k in use)
            made.append((t, times, use))
            for n, k in use:
                left[n] -= k * times
                if not left[n]:
                    lane = routed[tier(n, capacity)]
                    lane.pop(bisect_right(lane, n) - 1)
    return made


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, n_tokens, tier, container, container_tier, position, starts_at, step_group): the place of every item, the tier that it is routed to and the tier that its container is packed for.

    Items of size 0 or NULL take no container. An item larger than the capacity is cut into full
    pieces and a rest (``piece`` from 0); no other item is split. ``key`` should be unique, rows that
    repeat are packed as items of their own. An empty table gives an empty result.
    """
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))
    df = items.select(items[key].alias("k"), items[size].alias("n")).where("n > 0").select("k", "n", F.explode(pieces).alias("piece"))
    df = df.select("k", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n"))
    df = df.repartitionByRange("n", "k", "piece").sortWithinPartitions("n", "k", "piece")
    df = cut(df.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = {r.part: r.c for r in df.groupBy("part").agg(F.count("*").alias("c")).collect()}
    before = dict(zip(sorted(parts), accumulate([0, *[parts[p] for p in sorted(parts)]]), strict=False))
    hist = {r.n: r.c for r in df.groupBy("n").agg(F.count("*").alias("c")).collect()}
    made = patterns(hist, capacity)
    first = dict(zip(sorted(hist), accumulate([0, *[hist[n] for n in sorted(hist)]]), strict=False))
    # ranges of items in order of length: (start, items in a container, first container, offset of the first item, position)
    taken = dict(first)
    ranges, container = [], 0
    costs = []
    for t, times, use in made:
        offset = position = 0
        for n, k in use:
            ranges.append((taken[n], k, container, offset, position, n, t))
            taken[n] += k * times
            offset += n * k
            position += k
        costs.append((sum(k * n * n for n, k in use), container, times))
        container += times
    ranges.sort()
    plan = np.array(ranges, np.int64).reshape(-1, 7)
    # containers in order of cost, dealt forth and back over the groups
    groups = max(1, -(-container // STEP))
    ranks = np.array([(c, r, t) for (_, c, t), r in zip(sorted(costs), accumulate([0, *[t for _, _, t in sorted(costs)]]), strict=False)], np.int64).reshape(-1, 3)
    ranks = ranks[np.argsort(ranks[:, 0])]
    kind = items.schema[key].dataType.simpleString()
    offsets = np.zeros(max(before, default=0) + 1, np.int64)
    for p, b in before.items():
        offsets[p] = b

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            at = offsets[b.column(3).to_numpy()] + b.column(4).to_numpy()
            r = plan[np.searchsorted(plan[:, 0], at, "right") - 1] if len(plan) else np.zeros((len(at), 7), np.int64)
            inside = at - r[:, 0]
            nth = inside % np.maximum(r[:, 1], 1)
            c = r[:, 2] + inside // np.maximum(r[:, 1], 1)
            g = ranks[np.searchsorted(ranks[:, 0], c, "right") - 1] if len(ranks) else np.zeros((len(at), 3), np.int64)
            rank = g[:, 1] + c - g[:, 0]
            turn, spot = rank // groups, rank % groups
            group = np.where(turn % 2 == 0, spot, groups - 1 - spot)
            tiers = np.minimum(TIERS - 1, np.floor(np.log2(np.maximum(1, capacity // np.maximum(n, 1)))).astype(np.int64))
            columns = [b.column(0), b.column(1), b.column(2), pa.array(tiers, pa.int32()), pa.array(c), pa.array(r[:, 6], pa.int32()), pa.array(r[:, 4] + nth, pa.int32()), pa.array(r[:, 3] + nth * n, pa.int32()), pa.array(group)]
            yield pa.RecordBatch.from_arrays(columns, ["k", "piece", "n_tokens", "tier", "container", "container_tier", "position", "starts_at", "step_group"])

    out = df.select("k", "piece", "n", "part", "row").mapInArrow(place, f"k {kind}, piece int, n_tokens int, tier int, container long, container_tier int, position int, starts_at int, step_group long")
    return out.withColumnRenamed("k", key)


def packed_specs(items: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``pack`` for each row (container_name, capacity_tokens) of ``specs``, a small table of settings."""
    done = None
    for r in specs.select("container_name", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("container_name").collect():
        one = pack(items, r.capacity_tokens, key, size).select(F.lit(r.container_name).alias("container_name"), F.lit(r.capacity_tokens).alias("capacity_tokens"), "*")
        done = one if done is None else done.unionByName(one)
    return done


def p8_containers(spark, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = cut(token_counts(table(spark, sf_dir, "documents"), path=tokenizer))
    return packed_specs(sizes, table(spark, sf_dir, "container_specs"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """By container kind and tier: containers, tokens, share of room used, tokens that came from shorter tiers, and how even the step groups are."""
    packed = cut(p8_containers(spark, sf_dir))
    cost = F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))
    groups = packed.groupBy("container_name", "step_group").agg(cost.alias("cost")).groupBy("container_name").agg(F.min("cost").alias("least_cost"), F.max("cost").alias("most_cost"))
    filled = F.sum(F.when(F.col("tier") > F.col("container_tier"), F.col("n_tokens")).otherwise(0))
    fill = packed.groupBy("container_name", "capacity_tokens", "container_tier").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"), filled.alias("from_shorter_tiers"))
    return fill.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)).join(groups, "container_name")


def p8_limits(spark, sf_dir: str) -> DataFrame:
    """What must hold of every packing: (container_name, overfull, split, lost) = containers over capacity, items split that fit whole, items whose pieces do not add up to them."""
    sizes = cut(token_counts(table(spark, sf_dir, "documents")))
    specs = table(spark, sf_dir, "container_specs")
    packed = cut(packed_specs(sizes, specs))
    full = packed.groupBy("container_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("t")).groupBy("container_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    items = packed.groupBy("container_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"))
    all_ = sizes.where("n_tokens > 0").crossJoin(F.broadcast(specs.select("container_name")))
    held = all_.join(items, ["container_name", "doc_id"], "full")
    counts = held.groupBy("container_name").agg(F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("split"), F.count_if(~F.col("t").eqNullSafe(F.col("n_tokens"))).alias("lost"))
    return counts.join(full, "container_name")


SQL = {"p8_limits": "SELECT container_name, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS lost FROM container_specs"}
