"""Filling containers of fixed capacity with whole documents.

Large items (above a third of the capacity) are matched first, at most two to
a container, greedily from the largest; small items then best-fit into what
room is left. Documents are spread over shards by hash, and each shard packs
by itself, so work per task stays fixed at any size; a shard wastes less than
its few last containers.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathlake.session import cut

#: Documents a shard holds on average. It fixes both the memory of a task and the waste.
SHARD_DOCS = 8192
#: Tasks that pack, at most; a task with several shards packs one after the other.
TASKS = 20_000


def match_large(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of one or two large items: each, from the largest, takes the largest mate that still fits."""
    order = np.argsort(sizes, kind="stable")
    left = [(int(sizes[i]), int(i)) for i in order]
    out = []
    while left:
        size, i = left.pop()
        k = bisect_right(left, (capacity - size, 1 << 62)) - 1
        out.append([i, left.pop(k)[1]] if k >= 0 else [i])
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; sizes lie between 1 and the capacity."""
    sizes = np.asarray(sizes)
    out = np.zeros(len(sizes), np.int64)
    large = np.flatnonzero(sizes * 3 > capacity)
    rooms: list[tuple[int, int]] = []
    n = 0
    for group in match_large(sizes[large], capacity):
        members = large[group]
        out[members] = n
        if room := capacity - int(sizes[members].sum()):
            rooms.append((room, n))
        n += 1
    rooms.sort()
    small = np.flatnonzero(sizes * 3 <= capacity)
    for i in small[np.argsort(-sizes[small], kind="stable")]:
        size = int(sizes[i])
        k = bisect_right(rooms, (size, -1))  # the tightest room that holds it
        room, box = rooms.pop(k) if k < len(rooms) else (capacity, n)
        n = max(n, box + 1)
        out[i] = box
        if room > size:
            insort(rooms, (room - size, box))
    return out


_SCHEMA = "doc_id bigint, capacity_id int, piece int, token_start bigint, token_end bigint, shard bigint, container bigint"


def _packer(capacities: list[tuple[int, int]]):
    names = ["doc_id", "capacity_id", "piece", "token_start", "token_end", "shard", "container"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column(0)[r].as_py()
                docs = batch.column(1)[r].values
                ids, tokens = docs.field(0).to_numpy(), docs.field(1).to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, tokens = ids[order], tokens[order]
                for cid, cap in capacities:
                    k = np.maximum(1, -(-tokens // cap))  # pieces of each document
                    row = np.repeat(np.arange(len(ids)), k)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                    start = piece * cap
                    end = np.minimum(start + cap, tokens[row])
                    box = np.full(len(row), -1, np.int64)
                    some = np.flatnonzero(end > start)
                    box[some] = pack((end - start)[some], cap)
                    cols = (ids[row], np.full(len(row), cid), piece, start, end, np.full(len(row), shard), box)
                    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                    arrays[-1] = pa.array(box, pa.int64(), mask=box < 0)
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack_documents(sized: DataFrame, capacities: list[tuple[int, int]], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A container for each document, or for each piece of one that alone exceeds the capacity.

    ``sized(doc_id, n_tokens)`` has one row per document, a row given again counts
    once; ``capacities`` lists
    ``(capacity_id, tokens)``. A document within the capacity is never split; a
    larger one fills whole containers and its rest is packed like an item.
    Result: ``doc_id, capacity_id, piece, token_start, token_end, shard,
    container``; containers are numbered within (capacity_id, shard). Documents
    without tokens need no container: theirs is null. Rows with a null
    ``doc_id`` are left out and null sizes count as 0. Capacities must be
    positive. The result does not depend on how the input is partitioned.
    """
    if any(c <= 0 for _, c in capacities):
        raise ValueError("capacities must be positive")
    sized = cut(sized.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens")).dropna().dropDuplicates(["doc_id"]))
    shards = max(1, round(sized.count() / shard_docs))
    # packing is bound by CPU, not bytes: a partition number of our own keeps small shards apart
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(min(4 * shards, TASKS), "shard")
    grouped = sized.groupBy("shard").agg(F.collect_list(F.struct("doc_id", "n_tokens")).alias("docs"))
    return grouped.mapInArrow(_packer(capacities), _SCHEMA)


def container_fill(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Containers, tokens held and the share of room left, by capacity."""
    size = F.create_map(*[F.lit(x) for c in capacities for x in c]) if capacities else F.lit(None)
    boxes = packed.filter("container is not null").groupBy("capacity_id", "shard", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("items"))
    total = boxes.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.avg("items").alias("items_each"))
    return total.withColumn("capacity_tokens", size[F.col("capacity_id")]).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
