"""First in a period with state by bucket: many keys a bucket, null keys, restarts and expired state give what a plain loop gives."""

from __future__ import annotations

import math

from brinewatch.streaming import stateful
from tests.test_stateful import kept, streamed


def test_buckets_of_keys(spark, tmp_path):
    rows = [(i, i // 9 + 500 * (i // 700), None if i % 11 == 0 else i * 7 % 60, ("view", "error")[i % 2], 1.0) for i in range(2100)]
    got = streamed(spark, tmp_path, rows, 3, lambda e: stateful.first_in_period(e, ["user_id", "event_type"], 30, buckets=3), restart=True)
    want = kept(rows, 30)
    assert len(want) < len(rows) // 2 and not any(isinstance(r[1], float) and math.isnan(r[1]) for r in got)
    assert [r[:3] for r in got] == want
