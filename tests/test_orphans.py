from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.bitmaps import Bitmap
from skein.operators import orphans

T = "record_id string, head string, tail string, received_at timestamp_ntz, period string, key string"
M = "mention_id string, received_at timestamp_ntz, deleted_at timestamp_ntz, field int"


def at(day: int, month: int = 1):
    return datetime(2024, month, day)


def uid(n: int) -> str:
    return f"00000000-0000-0000-0000-{n:012d}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200_000)), st.lists(st.integers(0, 200_000)))
def test_andnot_is_set_difference(a, b):
    left = Bitmap.of(np.array(a, dtype=np.int64)).andnot(Bitmap.of(np.array(b, dtype=np.int64)))
    assert left.ids().tolist() == sorted(set(a) - set(b)) and len(left) == len(set(a) - set(b))


def test_dense_containers_are_bitsets():
    a, b = np.arange(0, 140_000), np.arange(0, 140_000, 3)
    left = Bitmap.of(a).andnot(Bitmap.of(b))
    assert left.ids().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert Bitmap.of(a).nbytes < 3 * 8192 + 1


def test_references_are_judged_at_the_first_delivery(spark):
    records = spark.createDataFrame(
        [
            ("live", uid(1), None, at(10), "x", "y"),
            ("live", uid(1), None, at(20), "x", "y"),  # delivered again
            ("early", uid(2), None, at(10), None, None),  # target arrives later in the month
            ("late", uid(2), None, at(20), None, None),
            ("gone", uid(3), None, at(20), None, None),  # deleted, known from the other copy only
            ("before", uid(3), None, at(5), None, None),
            ("never", uid(9), "no uuid", at(10, 2), None, None),
            ("spelled", "{" + uid(1).upper() + "}", " urn:uuid:" + uid(1), at(10), None, None),
            ("bare", uid(1).replace("-", ""), "", at(10), None, None),
            ("exact", uid(4), None, at(15), None, None),  # deleted at that very moment
            ("born", uid(5), None, at(15), None, None),  # received at that very moment
            (None, uid(9), None, at(10), None, None),
            ("undated", uid(9), None, None, None, None),
        ],
        T,
    )
    targets = spark.createDataFrame(
        [(uid(1), at(1), None, 7), (uid(2), at(15), None, 7), (uid(3), at(1), None, 7), (uid(3), at(3), at(12), 7), (uid(4), at(1), at(15), 7), (uid(5), at(15), None, 7), (None, at(1), None, 7)],
        M,
    )
    for ranges in (1, 5):
        refs = orphans.judged_references(records, "record_id", ["head", "tail"])
        found = orphans.orphan_references(refs, orphans.lifetimes(targets, "mention_id"), ranges)
        got = {(r.record_id, r.field, r.period - 2024 * 12) for r in found.collect()}
        assert got == {("early", 0, 0), ("gone", 0, 0), ("never", 0, 1), ("never", 1, 1), ("bare", 1, 0), ("exact", 0, 0)}


def test_hot_key_empty_tables_and_report(spark):
    records = spark.createDataFrame([(f"r{i}", uid(0 if i % 3 else i), None, at(3), None, None) for i in range(300)], T)
    targets = spark.createDataFrame([(uid(i), at(1), None, 0) for i in range(1, 300)], M)
    rows = orphans.orphans_of_table(records, "t", "record_id", [("head", targets, "mention_id"), ("tail", targets, "mention_id")])
    assert rows.count() == 201  # r0 refers to key 0 as well
    assert [tuple(r) for r in orphans.orphan_report(rows).collect()] == [("t", "head", "2024-01", 201)]
    assert orphans.orphans_of_table(records.limit(0), "t", "record_id", [("head", targets, "mention_id")]).count() == 0
    assert orphans.orphans_of_table(records, "t", "record_id", [("head", targets.limit(0), "mention_id")]).count() == 300


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    day = lambda: datetime(2024, int(rng.integers(1, 4)), int(rng.integers(1, 28)))
    recs = [(f"r{rng.integers(60)}", uid(int(rng.integers(40))), None if rng.random() < 0.3 else uid(int(rng.integers(40))), day(), None, None) for _ in range(150)]
    tars = [(uid(int(rng.integers(40))), day(), day() if rng.random() < 0.3 else None, 0) for _ in range(60)]
    first = {}
    for r in recs:
        first[r[0]] = min(first.get(r[0], r[3]), r[3])
    want = set()
    for r in recs:
        t = first[r[0]]
        for field, key in ((0, r[1]), (1, r[2])):
            copies = [x for x in tars if x[0] == key]
            if key and not (any(x[1] <= t for x in copies) and not any(x[2] and x[2] <= t for x in copies)):
                want.add((r[0], field, t.year * 12 + t.month - 1))
    refs = orphans.judged_references(spark.createDataFrame(recs, T), "record_id", ["head", "tail"])
    got = orphans.orphan_references(refs, orphans.lifetimes(spark.createDataFrame(tars, M), "mention_id"), 3)
    assert {tuple(r) for r in got.select("record_id", "field", "period").collect()} == want
