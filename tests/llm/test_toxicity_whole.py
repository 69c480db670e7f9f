"""The scan of op1 stays linear on long texts."""

import time

from sparkloom.llm import toxicity


def test_scan_of_falling_totals():
    hits = [(10 * i, 1.0) for i in range(40_000)]
    start = time.process_time()
    assert toxicity.segments(hits, 0.5) == [(p, p, 1.0) for p, _ in hits]
    assert time.process_time() - start < 2
