import itertools
import random

import pytest

from tidemark.llm import packing


def containers(plan):
    return sum(m for _, m in plan)


def check(plan, counts, capacity):
    used = [0] * (capacity + 1)
    for p, m in plan:
        assert m > 0 and sum(p) <= capacity
        for s in p:
            used[s] += m
    assert used[1:] == list(counts[1:])


def optimum(sizes, capacity):
    """Fewest containers, by trying them all (tiny instances)."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + (rooms[k] - sizes[i],) + rooms[k + 1 :])
        go(i + 1, rooms + (capacity - sizes[i],))

    sizes = sorted(sizes, reverse=True)
    go(0, ())
    return best[0]


def test_the_reduction_never_costs_a_container():
    r = random.Random(2)
    for _ in range(250):
        c = r.choice([10, 20, 30])
        sizes = [r.randint(1, c) for _ in range(r.randint(1, 8))]
        counts = [0] * (c + 1)
        for s in sizes:
            counts[s] += 1
        fixed, left = packing.reduce_instance(counts, c)
        rest = list(itertools.chain.from_iterable([s] * k for s, k in enumerate(left)))
        assert containers(fixed) + optimum(rest, c) == optimum(sizes, c)
        check(fixed + packing.best_fit(left, c), counts, c)


@pytest.mark.parametrize("seed", range(3))
def test_plans_are_complete_and_short(seed):
    r = random.Random(seed)
    counts = [0] + [r.choice([0, 1, 7, 1000, 10**7]) for _ in range(512)]
    plan = packing.plan_containers(counts, 512)
    check(plan, counts, 512)
    assert len(plan) < 4 * 512  # whatever the number of items
    need = sum(s * k for s, k in enumerate(counts))
    assert containers(plan) <= max(-(-need // 512) * 1.3, 1) + 1


SCHEMA = "doc_id long, text string, size long, rank long, piece_no string"


@pytest.mark.parametrize("per_block", [5, 100_000])
def test_pack_is_a_partition_of_the_tokens(spark, enc, per_block):
    texts = ["", None, "word " * 3000, "a b c", "a b c", *["short text number %d" % i for i in range(30)], *["x y " * 100] * 20, "日本語。" * 50]
    df = spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(df, rows_per_block=per_block).collect()
    load, parts = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.end_token - r.start_token
        parts.setdefault(r.doc_id, []).append((r.start_token, r.end_token))
    assert max(load.values()) <= 512 and set(load) == set(range(len(load)))
    for i, t in enumerate(texts):
        n, p = len(enc.encode_ordinary(t or "")), sorted(parts[i])
        assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:])) and (n > 512) == (len(p) > 1)


def test_empty(spark, enc):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
