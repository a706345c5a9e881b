"""Filling containers of fixed capacity with items of varying length, certified by lower bounds.

Items (document ids and sizes, no texts) are spread by hash into groups of bounded size and packed there by best-fit
decreasing. Dual-feasible functions give a lower bound on each group's containers. A group that meets its bound and
wastes less than half a container is certified; the others take the items out of their worst-filled containers and
exchange them: several groups pool them and pack them anew. Rounds go on until one pool is left. Every container carries the
count and the bound of the group it was packed in, and the same bound over the sizes of all items certifies the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibmill.session import stage

#: Items per group, groups per pool, and containers reopened: so many per container above the bound, and so many besides.
GROUP_ITEMS, POOL, REOPEN, BESIDES = 50_000, 8, 4, 4
PLACED_DDL = "budget_id int, capacity int, grp bigint, bin int, doc_id bigint, piece int, size int, open boolean, n_bins int, bound int"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest first, each into the fullest container that still holds it.

    Containers are kept by free room; the least sufficient room is found in a bit set, so an item costs the same
    however many containers there are. Equal sizes keep their order.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a container with room r
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = free[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            at, room = n, capacity
            n += 1
        out[i] = at
        room -= size
        free.setdefault(room, []).append(at)
        rooms |= 1 << room
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """A bound on the containers for items no larger than the capacity, by dual-feasible functions. ``counts``: items of each size.

    Of every packing that fits, the functions' sum per container is at most 1: the size itself; for a threshold a, items
    above capacity - a as whole containers and those below a as nothing; and for k, the size rounded down to k-ths
    where (k + 1) times it isn't whole.
    """
    counts = np.ones(len(sizes), np.int64) if counts is None else counts
    sizes, counts = sizes[sizes > 0].astype(np.int64), counts[sizes > 0]
    if not len(sizes):
        return 0
    value, at = np.unique(sizes, return_inverse=True)
    count = np.bincount(at, weights=counts).astype(np.int64)
    best = -(-int((value * count).sum()) // capacity)
    thresholds = np.unique(np.concatenate([value[value <= capacity // 2], capacity - value[value > capacity // 2]]))
    total, n = np.concatenate([[0], np.cumsum(value * count)]), np.concatenate([[0], np.cumsum(count)])
    for a in thresholds[thresholds > 0].tolist():
        low, high = np.searchsorted(value, a, "left"), np.searchsorted(value, capacity - a, "right")
        best = max(best, int(n[-1] - n[high]) + -(-int(total[high] - total[low]) // capacity))
    for k in range(1, 33):
        scaled = value * (k + 1)
        whole = scaled % capacity == 0
        weight = np.where(whole, value * k, scaled // capacity * capacity)  # times capacity * k
        best = max(best, -(-int((weight * count).sum()) // (capacity * k)))
    return best


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    sizes = pdf["size"].to_numpy()
    bins = best_fit_decreasing(sizes, capacity)
    n, bound = int(bins.max()) + 1, max(lower_bound(sizes, capacity), 1)
    filled = np.bincount(bins, weights=sizes, minlength=n)
    gap = n - bound
    waste = n - filled.sum() / capacity
    reopened = np.zeros(n, dtype=bool)
    if gap > 0 or waste > 0.5:
        reopened[np.argsort(filled, kind="stable")[: REOPEN * gap + BESIDES]] = True
    return pd.DataFrame({"budget_id": pdf["budget_id"], "capacity": capacity, "grp": pdf["grp"], "bin": bins, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "size": sizes, "open": reopened[bins], "n_bins": n, "bound": bound})


ITEM_DDL = "budget_id int, capacity int, doc_id bigint, piece int, start_byte bigint, size int"
ITEM = pa.schema([("budget_id", pa.int32()), ("capacity", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start_byte", pa.int64()), ("size", pa.int32())])


def cut_oversized(data: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of pieces as large as the capacity allows without cutting into a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + capacity, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return out


def _oversized(batches: Iterator[pa.RecordBatch], capacities: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode()
            for budget, capacity in capacities:
                if len(data) > capacity:
                    rows.extend((budget, capacity, doc, i, a, b - a) for i, (a, b) in enumerate(cut_oversized(data, capacity)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ITEM)], schema=ITEM)


def items(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """What is to be placed: each text whole, or its pieces where it exceeds the capacity. Null texts are none, null capacities no
    budget; a capacity that can't hold every character (below 4) is refused."""
    limits = [(r["budget_id"], r["max_tokens"]) for r in budgets.where("task = 'pack' and max_tokens is not null").select("budget_id", "max_tokens").collect()]  # a few rows
    if any(c < 4 for _, c in limits):
        raise ValueError(f"a container needs room for a character of four bytes: {limits}")
    if not limits:
        return documents.sparkSession.createDataFrame([], ITEM_DDL)
    size = F.octet_length("text")
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity")) for b, c in limits]))
    whole = documents.where("text is not null").select("doc_id", size.alias("size"), each.alias("b")).where("size <= b.capacity")
    whole = whole.select("b.budget_id", "b.capacity", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_byte"), "size")
    large = documents.select("doc_id", "text").where(size > min(c for _, c in limits))
    return whole.unionByName(large.mapInArrow(partial(_oversized, capacities=limits), ITEM_DDL))


def pack(documents: DataFrame, budgets: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every text placed once: budget_id, doc_id, piece, start_byte, size, container, place, offset, group_containers, group_bound.

    The last two are the containers and the lower bound of the group in which the item's container was packed. ``place`` counts a container's items from 0, ``offset`` is the byte at which an item starts in it. Empty texts take a
    place without room. Sizes alone travel; a group holds about ``group_items`` items and a pool the items of
    a few containers from each of its groups, whatever the size of the table.
    """
    todo = stage(items(documents, budgets))
    counts = todo.groupBy("budget_id").count().collect()  # a row per budget
    groups = max([1, *(math.ceil(r["count"] / group_items) for r in counts)])
    rows = todo.drop("start_byte").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    done: list[DataFrame] = []
    level = 0
    while True:
        placed = stage(rows.groupBy("budget_id", "grp").applyInPandas(_pack, PLACED_DDL))
        name = F.concat_ws("-", "budget_id", F.lit(level), "grp", "bin").alias("container")
        last = groups == 1
        done.append(placed.where(F.lit(True) if last else ~F.col("open")).select("budget_id", "doc_id", "piece", "size", name, F.col("n_bins").alias("group_containers"), F.col("bound").alias("group_bound")))
        if last:
            break
        groups, level = math.ceil(groups / POOL), level + 1
        rows = placed.where("open").select("budget_id", "capacity", "doc_id", "piece", "size", F.floor(F.col("grp") / POOL).alias("grp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # A container holds at most its capacity in items of one byte or more, and its place in it follows from one window.
    order = "over (partition by container order by size desc, doc_id, piece rows between unbounded preceding and current row)"
    placed = out.withColumns({"place": F.expr(f"cast(count(*) {order} - 1 as int)"), "offset": F.expr(f"cast(sum(size) {order} - size as int)")})
    starts = todo.where("piece > 0").select("budget_id", "doc_id", "piece", "start_byte")
    return placed.join(starts, ["budget_id", "doc_id", "piece"], "left").select("budget_id", "doc_id", "piece", F.coalesce("start_byte", F.lit(0)).alias("start_byte"), "size", "container", "place", "offset", "group_containers", "group_bound")


def _bound_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"budget_id": pdf["budget_id"].iloc[:1], "bound": [lower_bound(pdf["size"].to_numpy(), int(pdf["max_tokens"].iloc[0]), pdf["n"].to_numpy())]})


def report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: items, containers, bytes, the share of room left over, and how far the packing is certified.

    ``least_containers`` is the bound by the sum of sizes, ``bound`` the best one by dual-feasible functions over all items, ``gap`` the
    containers above it (0: no packing needs fewer); ``groups`` the groups in which final containers were packed and ``groups_at_bound``
    those among them that met their own bound. Sizes are counted before they are shuffled: a budget has at most its capacity of them.
    """
    packed = packed.join(budgets.select("budget_id", "max_tokens").dropDuplicates(["budget_id"]), "budget_id")
    totals = packed.groupBy("budget_id", "max_tokens").agg(F.count("*").alias("n_items"), F.countDistinct("container").alias("n_containers"), F.sum("size").alias("n_bytes"))
    bounds = packed.groupBy("budget_id", "max_tokens", "size").agg(F.count("*").alias("n")).groupBy("budget_id").applyInPandas(_bound_of, "budget_id int, bound bigint")
    group = packed.select("budget_id", F.substring_index("container", "-", 3).alias("grp"), "group_containers", "group_bound").distinct()
    groups = group.groupBy("budget_id").agg(F.count("*").alias("groups"), F.count_if(F.col("group_containers") == F.col("group_bound")).alias("groups_at_bound"))
    left = 1 - F.try_divide(F.col("n_bytes").cast("double"), F.col("n_containers") * F.col("max_tokens"))
    return totals.join(bounds, "budget_id").join(groups, "budget_id").select("budget_id", "n_items", "n_containers", "n_bytes", F.ceil(F.col("n_bytes") / F.col("max_tokens")).alias("least_containers"), "bound", (F.col("n_containers") - F.col("bound")).alias("gap"), left.alias("left_over"), "groups", "groups_at_bound")


def audit(packed: DataFrame, documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """What must hold of a packing, counted: (budget_id, documents, bytes, over_capacity, twice, not_whole, gaps).

    documents and bytes placed; containers above the capacity; pieces placed more than once; documents within the capacity that
    were cut, or whose pieces don't add up to their text; containers whose items don't lie end to end in their places.
    """
    capacity = budgets.where("task = 'pack'").select("budget_id", "max_tokens").dropDuplicates(["budget_id"])
    texts = documents.where("text is not null").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("own"), F.max(F.octet_length("text")).alias("longest"), F.count("*").alias("copies"))
    of_bin = packed.groupBy("budget_id", "container").agg(F.sum("size").alias("load"), F.sort_array(F.collect_list(F.struct("place", "offset", "size"))).alias("i"))  # a container's items
    tight = F.aggregate("i", F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(True).alias("ok")), lambda a, x: F.struct((a["at"] + x["size"]).cast("int").alias("at"), (a["k"] + 1).alias("k"), (a["ok"] & (x["offset"] == a["at"]) & (x["place"] == a["k"])).alias("ok")))["ok"]
    bins = of_bin.withColumn("_tight", tight).join(capacity, "budget_id").groupBy("budget_id").agg(F.count_if(F.col("load") > F.col("max_tokens")).alias("over_capacity"), F.count_if(~F.col("_tight")).alias("gaps"))
    pieces = packed.groupBy("budget_id", "doc_id", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    docs = pieces.groupBy("budget_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("bytes"), F.max("n").alias("n")).join(capacity, "budget_id").join(texts, "doc_id", "left")
    whole = (F.col("bytes") == F.col("own")) & ((F.col("longest") > F.col("max_tokens")) | (F.col("pieces") == 1))
    of_doc = docs.groupBy("budget_id").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > F.coalesce("copies", F.lit(0))).alias("twice"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole"))
    return of_doc.join(bins, "budget_id").select("budget_id", "documents", "bytes", "over_capacity", "twice", "not_whole", "gaps")
