import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from specframe.llm import ranges
from specframe.llm.common import map_arrow


def packed(spark, lists, parts, how=ranges.SUMS, most=50):
    df = spark.createDataFrame([(x,) for x in lists], "x array<struct<k: long, n: long, t: long>>").repartition(3)

    def run(batches):
        adder = ranges.Adder(parts, how, most)
        for batch in batches:
            for rows in batch.column(0).to_pylist():
                cols = [np.array([r[c] for r in rows], dtype=np.int64) for c in ("k", "n", "t")]
                yield from adder.add(cols[0].view(np.uint64), cols[1], cols[2])
        yield from adder.flush()

    return map_arrow(df, run, ranges.PACKED)


def test_sums_against_counters(spark, monkeypatch):
    r = random.Random(3)
    keys = [r.getrandbits(63) for _ in range(200)] + [0, (1 << 63) - 1]
    hot = keys[0]
    lists = [[(r.choice(keys) if r.random() < 0.6 else hot, r.randint(0, 40), r.randint(0, 9)) for _ in range(60)] for _ in range(30)] + [[]]
    n, t = Counter(), Counter()
    for rows in lists:
        for k, a, b in rows:
            n[k] += a
            t[k] += b
    for parts in (1, 7):
        found, told = ranges.store(packed(spark, lists, parts), "test", parts, lambda k, a, b: a > 20)
        kept = {k for k in n if n[k] > 20}
        assert told == [len(kept), sum(n[k] for k in kept), sum(t[k] for k in kept), sum(n.values()), sum(t.values())]
        wanted = np.array(sorted(set(keys) | {r.getrandbits(63) for _ in range(50)}), dtype=np.uint64)
        for found_, most in ((found, 1000), (pickle.loads(pickle.dumps(found)), 1)):  # also with one range open at once
            monkeypatch.setattr(ranges, "MOST_OPEN", most)
            there, a, b = found_.find(wanted)
            assert there.tolist() == [k in kept for k in wanted.tolist()]
            assert a.tolist() == [n[k] if k in kept else 0 for k in wanted.tolist()] and b.tolist() == [t[k] if k in kept else 0 for k in wanted.tolist()]
    assert not pickle.loads(pickle.dumps(found)).maps and found.maps


def test_spans_and_nothing(spark):
    lists = [[(5, 1, 1), (6, 2, 2)], [(5, 9, 9), (6, 2, 2)]]
    found, told = ranges.store(packed(spark, lists, 2, ranges.SPAN), "test", 2, lambda k, a, b: a != b, ranges.SPAN)
    assert told[0] == 1 and found.find(np.array([5, 6], dtype=np.uint64))[0].tolist() == [True, False]
    none, told = ranges.store(packed(spark, [[]], 2), "test", 2, lambda k, a, b: a > 0)
    assert told == [0] * 5 and not none.find(np.array([1], dtype=np.uint64))[0].any()


def test_ranges_are_in_order():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.uint64))
    for parts in (1, 3, 51, 1000):
        p = ranges.part_of(keys, parts)
        assert (np.diff(p) >= 0).all() and p[0] >= 0 and p[-1] < parts
    assert ranges.added(*[np.zeros(0, dtype=np.uint64)] * 3)[0].tolist() == []
    rows = list(ranges.by_range(keys, 7, {"keys": keys}))
    assert sum(len(x) // 8 for b in rows for x in b.column("keys").to_pylist()) == len(keys) and isinstance(rows[0], pa.RecordBatch)
