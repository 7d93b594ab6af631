import random

import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and near(i, j) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for t in ("", None, "  \n", "one", "A b C", "The cat sat on the mat the cat sat on", "x " * 5000, "é ü ñ " * 7, "a\xa0b c\x0bd e f"):
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_connect_exactly_the_close(spark, crowd):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for base in list(fps)[:12]:
        for _ in range(12):
            f = base
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(map(signed, fps))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for n in (10, 10_000_000):
        got = {r["node"]: r["root"] for r in components(simhash.links(nodes, n, 4, crowd)).collect()}
        want = slow_components(fps, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4)
        assert {f: got.get(f, f) for f in fps} == want


def test_classes_edge_cases(spark):
    rows = [(5, "a b c d e", "x"), (3, "A B C D E", "y"), (3, "a b c d e", None), (9, None, "z"), (8, "", None), (None, "a b c d e", "q"), (None, "lonely words stand here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.classes(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (None, None), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)], key=str)
    assert simhash.classes(df.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: slow_fingerprint(t) for i, t in rows.items()}
    want = slow_components(sorted(rows), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4)
    got = {r["doc_id"]: (r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in simhash.classes(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in rows}
