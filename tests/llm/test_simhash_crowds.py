import itertools
import random

import pytest

from plumbline.llm import simhash as m


@pytest.mark.parametrize(("radius", "block"), [(6, 512), (6, 7), (3, 20)])
def test_crowded_buckets_link_every_pair(spark, monkeypatch, radius, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((3, 5, 8)))) for _ in range(150)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    near = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    found = m.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, small=2).collect()
    assert near and {(min(r.a, r.b), max(r.a, r.b)) for r in found} == near


@pytest.mark.parametrize("radius", [1, 2])
def test_narrow_crowds_connect(spark, radius):
    rng = random.Random(9)
    fps = {0}
    while len(fps) < 120:
        fps.add(rng.choice(list(fps)) ^ 1 << rng.randrange(63))
    found = m.components(m.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, small=2)).collect()
    assert {r.node for r in found} == fps and {r.component for r in found} == {0}
