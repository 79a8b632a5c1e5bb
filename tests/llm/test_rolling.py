"""Hashes of all ranges of one width are those of the ranges one by one."""

import numpy as np

from rowmend.llm import packed


def test_each_range_as_one_by_one():
    rng = np.random.default_rng(5)
    for n in (64, 65, 1023, 1024, 1025, 1088, 5000, packed.AT_ONCE, packed.AT_ONCE + 63, packed.AT_ONCE + 64, 3 * packed.AT_ONCE + 1100):
        rolling = packed.Rolling(rng.integers(0, 2**62, n, dtype=np.uint64), n % 2)
        at = np.arange(n - 64 + 1)
        assert (rolling.each(64) == rolling.of(at, at + 64)).all()


def test_remainders():
    p = int(packed.PRIME)
    x = [0, 1, p - 1, p, p + 1, 2 * p - 1, 2 * p, p * p, (p - 1) ** 2, 2**62 - 1, 2**31, 2**32, 2**63, 2**64 - 1]
    x += np.random.default_rng(1).integers(0, 2**62, 1000).tolist()
    assert packed._reduced(np.array(x, np.uint64)).tolist() == [v % p for v in x]
    assert [v % p for v in packed._folded(np.array(x, np.uint64)).tolist()] == [v % p for v in x]
    small, large = packed._folded(np.array([2**62 - 1, 2**64 - 1], np.uint64)).tolist()
    assert small < 2**32 and large < 2**34
