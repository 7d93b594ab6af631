import random

import numpy as np
import pytest

from tessera.llm import suffixes


def strings(rnd, n, alphabet, longest):
    pool = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]
    return pool + [p[: len(p) // 2] + rnd.choice(pool) for p in pool]


@pytest.mark.parametrize("alphabet,depth", [(b"ab", 9), (b"a", 5), (bytes(range(256)), 3), (b"\x00\xffx", 20)])
def test_order_and_common_prefixes(alphabet, depth):
    rnd = random.Random(depth)
    shard = suffixes.Shard(strings(rnd, 30, alphabet, 60), depth)
    text = shard.text.tolist()
    ends = np.searchsorted(shard.starts, np.arange(len(text)), side="right") - 1
    past = (shard.starts + shard.lengths)[ends].tolist()
    tail = lambda i: (text[i : past[i]], past[i])
    order = sorted(range(len(text)), key=tail)
    assert [tail(i)[0] for i in shard.array.tolist()] == [tail(i)[0] for i in order]
    shared = shard.common()
    for slot in range(1, len(text)):
        (a, _), (b, _), n = tail(shard.array[slot]), tail(shard.array[slot - 1]), 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[slot] == n


@pytest.mark.parametrize("shard_bytes", [60, 400, 1 << 20])
def test_repeats_across_shards(shard_bytes):
    rnd = random.Random(shard_bytes)
    for alphabet in (b"ab", b"abcdefgh"):
        some = strings(rnd, 25, alphabet, 50)
        ages = rnd.sample(range(0, 100_000, 1000), len(some))
        got = suffixes.repeated_windows(some, np.array(ages, dtype=np.int64), 8, shard_bytes)
        first = {}
        for s, o in zip(some, ages):
            for i in range(len(s) - 7):
                first[s[i : i + 8]] = min(first.get(s[i : i + 8], 1 << 60), o + i)
        for s, o, g in zip(some, ages, got):
            assert g.tolist() == [i for i in range(len(s) - 7) if first[s[i : i + 8]] < o + i]
