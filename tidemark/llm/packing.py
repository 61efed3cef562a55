"""Texts into containers of fixed capacity: dominance reduction, then best fit.

Sizes are whole tokens up to the capacity, so the instance is a histogram of at most `capacity` counts. The
Martello-Toth reduction and the best fit work on it and yield a plan of container patterns (how many containers
hold which sizes), whose length depends on the capacity and not on the number of texts. Items are then ranked within
their size by a block scan and take the place of the plan that their rank names; no item is sent to the driver and a
size that holds a third of all items is spread over many tasks.

Reduction: a set of items F with item j dominates every other feasible set with j if the others' items can be
exchanged for F's without needing more room; then F may be fixed for good. Tested for the largest item j of each
size: nothing fits with it; the largest that fits fills the container exactly; no two others fit with it; no three
others fit and the best pair is no larger than the best single item, or is that item with its best companion while
no pair of two larger companions fits.

Defined cases: only a text larger than the capacity is divided, into full containers and one rest, which is an item
like any other. Texts of no tokens (null, empty) take no room and are spread over the containers. Equal sizes are
ordered by id and piece, so a repeated id is harmless. An empty table needs no container.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.operators.blocks import ROWS_PER_BLOCK, ordered_blocks, rank_in_group
from tidemark.runtime import cut

CAPACITY = 512
Plan = list[tuple[tuple[int, ...], int]]


def reduce_instance(counts: list[int], capacity: int) -> tuple[Plan, list[int]]:
    """(fixed patterns, what is left). counts[s]: items of size s, 1 <= s <= capacity; counts[0] is ignored."""
    n = [0, *counts[1:]]
    fixed: Plan = []

    def smallest(without: int, above: int, k: int) -> list[int]:
        """The k smallest sizes over `above`, one item of size `without` aside."""
        out: list[int] = []
        for s in range(above + 1, capacity + 1):
            out += [s] * min(n[s] - (s == without), k - len(out))
            if len(out) == k:
                break
        return out

    def fits(j: int, *others: int) -> int:
        """How often the set can be taken from what is there."""
        need: dict[int, int] = {}
        for s in (j, *others):
            need[s] = need.get(s, 0) + 1
        return min(n[s] // k for s, k in need.items())

    def largest(j: int, room: int, taken: tuple[int, ...] = ()) -> int:
        return next((s for s in range(room, 0, -1) if n[s] - (s == j) - taken.count(s) > 0), 0)

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while n[j]:
                room = capacity - j
                p = largest(j, room)
                low = smallest(j, 0, 3)
                take: tuple[int, ...] | None = None
                if not p:
                    take = (j,)
                elif p == room or len(low) < 2 or low[0] + low[1] > room:
                    take = (j, p)
                elif len(low) < 3 or sum(low) > room:
                    pair = max(((x + y, x, y) for x in range(room - 1, 0, -1) if n[x] - (x == j) > 0 and (y := largest(j, min(x, room - x), (x,)))), default=(0, 0, 0))
                    y = largest(j, room - p, (p,))
                    over = smallest(j, y, 2)
                    if p >= pair[0]:
                        take = (j, p)
                    elif y and (len(over) < 2 or sum(over) > room):
                        take = (j, p, y)
                if take is None:
                    break
                m = fits(*take) or 1
                for s in take:
                    n[s] -= m
                fixed.append((take, m))
                changed = True
    return fixed, n


def best_fit(counts: list[int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: containers that are alike are kept as one group."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> groups (sizes in it, containers)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], m: int) -> None:
        if m:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((pattern, m))

    for s in range(capacity, 0, -1):
        left = counts[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                put(capacity, (), -(-left // (capacity // s)))
                continue
            room = rooms[i]
            pattern, m = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            each = room // s  # the tightest container takes as many as fit before the next one is tried
            full = min(m, left // each)
            rest = left - full * each if full < m else 0
            put(room - each * s, pattern + (s,) * each, full)
            if rest:
                put(room - rest * s, pattern + (s,) * rest, 1)
            put(room, pattern, m - full - (rest > 0))
            left -= full * each + rest
    return [(p, m) for groups in open_.values() for p, m in groups if p]


def plan_containers(counts: list[int], capacity: int) -> Plan:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(plan: Plan) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """For each size the ranks at which intervals begin, and what to add to a rank of the interval for its container."""
    next_rank: dict[int, int] = {}
    at: dict[int, tuple[list[int], list[int]]] = {}
    base = 0
    for pattern, m in plan:
        for s in pattern:
            lo = next_rank.get(s, 0)
            starts, shift = at.setdefault(s, ([], []))
            starts.append(lo)
            shift.append(base - lo)
            next_rank[s] = lo + m
        base += m
    return {s: (np.array(a), np.array(b)) for s, (a, b) in at.items()}, base


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = tokens.FOLDER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""

    def count(batches):
        e = tokens.encoding(folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [len(t) for t in e.encode_ordinary_batch([x or "" for x in b.text], num_threads=1)]})

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(count, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", folder: str = tokens.FOLDER, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(doc_id, piece_no, start_token, end_token, container_id)."""
    sizes = cut(token_sizes(docs, doc_id, text, folder))
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0).cast("long"))), lambda i: i * capacity)
    items = sizes.select("doc_id", "n_tokens", F.posexplode(cuts).alias("piece_no", "start_token")).withColumn("end_token", F.least(F.col("start_token") + capacity, F.col("n_tokens")))
    items = items.select("doc_id", "piece_no", "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("size"))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    places, containers = _places(plan_containers([histogram.get(s, 0) for s in range(capacity + 1)], capacity))
    b = ordered_blocks(items, ["size", "doc_id", "piece_no"], sum(histogram.values()), rows_per_block)
    kind = docs.schema[doc_id].dataType.simpleString()
    ranked = rank_in_group(b, "size", f"doc_id {kind}, piece_no int, start_token long, end_token long, size long")

    def place(batches):
        for x in batches:
            r, out = x["rank"].to_numpy(), np.zeros(len(x), "int64")
            for s in x["size"].unique():
                i = (x["size"] == s).to_numpy()
                if s == 0:
                    out[i] = r[i] % max(1, containers)
                else:
                    starts, shift = places[int(s)]
                    out[i] = r[i] + shift[np.searchsorted(starts, r[i], "right") - 1]
            yield x[["doc_id", "piece_no", "start_token", "end_token"]].assign(container_id=out)

    return ranked.mapInPandas(place, f"doc_id {kind}, piece_no int, start_token long, end_token long, container_id long")
