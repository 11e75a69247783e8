import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.mixing import LEAST_SLOTS, MOST_WORDS, mix, mixed_documents, planned, schedule, targets


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def order(name):
    return (name is None, (name or "").encode())


def drawn(target):
    """The schedule by its definition: slots in order, each one's point looked up among the cumulative shares."""
    names = sorted(target, key=order)
    block = {s: max(1.0, min(MOST_WORDS, target[s] / LEAST_SLOTS)) for s in names}
    share = {s: target[s] / block[s] for s in names}
    total = sum(share.values())
    bits = max(0, math.ceil(math.log2(total)))
    ends, end = [], 0.0
    for s in names:
        end += share[s]
        ends.append((round(end / total * 2**bits, 6), s))
    slots = {s: [] for s in names}
    for i in range(2**bits):
        point = int(f"{i:0{bits}b}"[::-1], 2) if bits else 0
        slots[next((s for e, s in ends if point < e), names[-1])].append(i)
    return slots, {s: round(block[s] * total / 2**bits * 65536) / 65536 if share[s] else 1.0 for s in names}


def brute(rows, cap=3):
    """Words taken of each (id, source, hash) by walking each source's blocks; rows: (id, size, source, hash)."""
    sizes = Counter()
    for _, size, source, _ in rows:
        sizes[source] += size
    want = fill(sizes)
    slots, block = drawn(want)
    taken, first = Counter(), {}
    for s in sizes:
        stream = [k for k, r in sorted(enumerate(rows), key=lambda x: (x[1][3] % 1024, x[1][3], x[1][0] or 0)) if r[2] == s for _ in range(r[1])]
        for rank, slot in enumerate(slots[s]):
            for at in range(int(rank * block[s]), int((rank + 1) * block[s])):
                if at < cap * len(stream):
                    k = stream[at % len(stream)]
                    taken[k] += 1
                    first.setdefault(k, slot)
                    first[k] = min(first[k], slot)
    return want, taken, first, block


def test_schedule_gives_what_is_taken(spark):
    rows = [(i, "w " * (i % 17), None if i % 11 == 0 else f"s{i % 5}" if i % 7 else "É") for i in range(400)]
    rows += [(1000 + i, "x y z", "big") for i in range(3000)] + [(5000, "t", "a-small"), (5001, None, "empty"), (None, "null id", "s1"), (7, "same " * 9, "s2"), (7, "same " * 9, "s2")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, sid int")
    held = [tuple(r) for r in docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " +"), lambda x: x != "")), "source", F.xxhash64("doc_id", F.xxhash64("text"))).collect()]
    want, taken, first, block = brute(held)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    plain = Counter((r[0], r[2], taken[k], first.get(k)) for k, r in enumerate(held) if r[0] != 7)
    assert plain == Counter((r.doc_id, r.source, r.taken, r.first_slot) for r in got if r.doc_id != 7)
    assert sum(taken[k] for k, r in enumerate(held) if r[0] == 7) == sum(r.taken for r in got if r.doc_id == 7)
    sizes, by = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        by[r.source] += r.taken
    assert all(r.source_size == sizes[r.source] for r in got)
    for s, n in by.items():
        assert abs(n - want[s]) <= 2 * block[s] + 1
    again = mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def slots_of(spark, sizes):
    rows = spark.createDataFrame([(k, f"s{k}", n, 1) for k, n in enumerate(sizes)], "sid long, source string, size long, rows long")
    plan, bits = planned(Scratch(spark, "test").put(targets(rows, (5, 2, 1), 3.0), "t"))
    return plan, bits


def test_slots_are_bounded_by_words_and_sources(spark):
    large, bits = slots_of(spark, [10**9, 10**9, 10**9])
    _, more = slots_of(spark, [10**9, 10**9, 10**9, 1])
    assert 2**bits <= 2 * (3 * 10**9 / MOST_WORDS + 3 * LEAST_SLOTS) and more <= bits + 1
    plan, bits = slots_of(spark, [70_000, 40_000, 500, 3, 90_000, 0])
    got = {}
    for r in schedule(plan, bits).collect():
        got.setdefault(r.sid, {})[r["rank"]] = r.slot
    want, _ = drawn({f"s{r.sid}": r.target for r in plan.collect()})
    assert {f"s{k}": [v[x] for x in sorted(v)] for k, v in got.items()} == {s: v for s, v in want.items() if v}
    assert sum(map(len, got.values())) == 2**bits


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0 and mixed_documents(docs).count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    assert [(r.taken, r.target) for r in mix(docs).collect()] == [(0, 0.0), (0, 0.0)]


def test_mixed_documents_hold_what_was_taken(spark):
    rows = [(i, f"only words of document {i} here", f"s{i % 3}") for i in range(90)] + [(200, "twin text", "s0"), (200, "twin text", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    held = {}
    for r in mixed_documents(docs).collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + len(r.text.split())
    assert held == {k: v for k, v in taken.items() if v}


def test_rows_are_told_apart_by_all_columns(spark):
    rows = [(1, "same words here", "a", 1), (1, "same words here", "b", 1), (1, "same words here", "b", 2), (2, "other words", "c", 1), (2, "other words", "c", 1), (3, None, "a", 0), (None, "no id at all", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, th int")
    taken, held = Counter(), Counter()
    for r in mix(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        held[r.doc_id, r.source] += len(r.text.split())
    assert held == +taken and {(1, "a"), (1, "b"), (2, "c"), (None, None)} <= set(held)


def test_parts_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"the text of {i}", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    first = {r.doc_id: [t.slot for t in r.turns] for r in mix(docs).collect() if r.taken}
    for part in mixed_documents(docs).select("doc_id", F.spark_partition_id().alias("p")).rdd.glom().collect():
        seen, slots = Counter(), []
        for r in part:
            slots.append(first[r.doc_id][seen[r.doc_id]])
            seen[r.doc_id] += 1
        assert slots == sorted(slots)
