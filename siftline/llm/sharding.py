"""Sharding by Karmarkar-Karp differencing: groups of documents that stay together, even bytes.

A partial partition is a sum of bytes for each of the shards.  Two partial partitions become one by
adding the largest sum of the one to the smallest of the other, and so on.  The two with the
largest spread are combined, again and again, until one is left.

The driver differences single groups up to ``CELL_GROUPS``.  More groups are dealt by hash into cells
of about that many, and one task packs each cell's groups into bundles, which the driver differences
as it does groups.  A large group is a bundle alone, whatever its cell, and nothing is levelled before
all large ones are known, so that all else can make up for them.  A cell's small groups make bundles
that get smaller to the end, down to single groups, so that the last ones even out what is left.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import cluster

SHARDS = 16
CELL_GROUPS = 50_000
#: Sums that the driver holds at first: its groups or bundles times the shards, about.
CELL_NUMBERS = 10_000_000
#: Bundles of a cell for each shard, about.
CELL_BUNDLES = 8


def difference(partials: np.ndarray) -> np.ndarray:
    """Combine partial partitions, a row each; the shard of each row's places.

    A heap holds them by spread (ties: the earlier first).  The merges are undone from the last to
    the first to find every place's shard.
    """
    n, k = partials.shape
    out = np.zeros((n, k), np.int64)
    if n == 0:
        return out
    order = np.argsort(-partials, axis=1, kind="stable")
    sums = [partials[i, order[i]] for i in range(n)]
    heap = [(float(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        turn = np.argsort(-total, kind="stable")
        sums.append(total[turn])
        merges.append((a, b, turn))
        heapq.heappush(heap, (float(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
        sums[a] = sums[b] = None
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, turn = merges[node - n]
        here = np.empty(k, np.int64)
        here[turn] = place.pop(node)  # position before sorting -> shard
        place[a] = here
        place[b] = here[::-1]
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def balance(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each size among the shards, and the places' sums."""
    sizes = np.asarray(sizes, np.int64)
    if shards < 1:
        raise ValueError("one shard at least")
    if len(sizes) == 0:
        return np.zeros(0, np.int64), np.zeros(shards, np.int64)
    order = np.argsort(-sizes, kind="stable")
    partials = np.zeros((len(sizes), shards), np.int64)
    partials[:, 0] = sizes[order]
    shard = np.empty(len(sizes), np.int64)
    shard[order] = difference(partials)[:, 0]
    return shard, np.bincount(shard, sizes, shards).astype(np.int64)


def bundles(sizes: np.ndarray, most: float) -> np.ndarray:
    """The bundle of each size, numbered from 0; ``sizes`` go down.

    A bundle grows up to ``most``, or to a quarter of what is left with it; one that is larger by itself
    is alone.  With ``most`` 0 each is alone.
    """
    out = np.arange(len(sizes))
    if most <= 0:
        return out
    done = np.concatenate(([0], np.cumsum(sizes)))
    first = number = 0
    while first < len(sizes):
        room = min(most, (done[-1] - done[first]) / 4)
        last = max(first + 1, int(np.searchsorted(done, done[first] + room, "right")) - 1)
        out[first:last] = number
        first, number = last, number + 1
    return out


def text_group() -> Column:
    """The production groups: documents of one text, so that copies never part."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def assign(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """``(doc_id, n_bytes, shard)`` of every row of ``docs``.

    A null or empty text has no bytes and is placed like others; a null group is a group; repeated
    rows go together.  Ties go by the groups' hashes.  Only ``doc_id``, ``text`` and what ``group``
    reads are read.
    """
    key = text_group() if group is None else F.xxhash64(group, group.isNull())
    rows = docs.select("doc_id", key.alias("g"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    groups = cluster.written(rows.groupBy("g").agg(F.sum("n_bytes").alias("size")))
    count, total = groups.agg(F.count("*"), F.sum("size")).first()
    cells = max(1, math.ceil(count / min(cell_groups, max(1, CELL_NUMBERS // shards))))
    cell = F.pmod(F.hash("g"), F.lit(cells))
    most = (total or 0) / min(CELL_BUNDLES * cells * shards, max(1, CELL_NUMBERS // shards)) if cells > 1 else 0.0

    def placed(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["size", "g"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"g": table["g"], "cell": table["cell"], "size": table["size"], "bundle": bundles(table["size"].to_numpy(), most).astype(np.int32)})

    local = cluster.written(groups.withColumn("cell", cell).groupBy("cell").applyInPandas(placed, "g bigint, cell int, size bigint, bundle int"))
    sums = local.groupBy("cell", "bundle").agg(F.sum("size").alias("size"), F.min("g").alias("g")).toArrow().sort_by([("cell", "ascending"), ("g", "ascending")])
    at, bundle = sums.column("cell").to_numpy(), sums.column("bundle").to_numpy()
    place, _ = balance(sums.column("size").to_numpy(), shards)
    begin = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=cells))))
    final = np.zeros(len(at), np.int32)
    final[begin[at] + bundle] = place

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(final[begin[b.column(1).to_numpy()] + b.column(2).to_numpy()])], ["g", "shard"])

    shard = local.select("g", "cell", "bundle").mapInArrow(moved, "g bigint, shard int")
    return rows.join(shard, "g").select("doc_id", "n_bytes", "shard")
