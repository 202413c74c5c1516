"""Bands with very many fingerprints are parted by further bits, and no link is lost."""

import random

import pytest
from weftgraph.llm import simhash


@pytest.mark.parametrize("shared", [(2,), (2, 4), (2, 4, 6)])
def test_hot_bands_lose_no_link(spark, shared):
    draw, low = random.Random(5), (1 << 30) - 1
    # 900 agree in their upper 34 bits, so several bands hold all of them; every tenth has a neighbour.
    values = {(0x2AAAAAAA << 34 & (1 << 64) - 1) | draw.getrandbits(30) for _ in range(900)}
    for v in sorted(values)[::10]:
        for flips in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in draw.sample(range(64), flips)))
    values |= {draw.getrandbits(64) for _ in range(200)} | {0, low}
    values = sorted(values)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {v: top(v) for v in values}
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), shared=shared, tile=40).collect()
    mask, joined = (1 << 64) - 1, {v: v for v in values}

    def head(v):
        while joined[v] != v:
            v = joined[v]
        return v

    for r in found:
        assert bin((r.a ^ r.b) & mask).count("1") <= 3 or want[r.a & mask] == want[r.b & mask]
        x, y = sorted((head(r.a & mask), head(r.b & mask)))
        joined[y] = x
    assert {v: head(v) for v in values} == want
