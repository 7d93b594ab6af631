import hashlib
import random

import pytest

from tessera.llm import substrings


def slow(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, digest) by a table of every window."""
    rows = sorted(((-(1 << 63) if i is None else i, (t or "").encode(), i) for i, t in rows), key=lambda r: r[:2])
    seen, out = set(), []
    for _, t, i in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fast(df, **options):
    got = substrings.repeated(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("alphabet,crowd", [("ab", 2000), ("a", 2000), ("abcdefghijkl é", 2000), ("abcdefghijkl é", 1), ("ab", 1)])
def test_against_window_table(spark, monkeypatch, alphabet, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rnd = random.Random(len(alphabet) + crowd)
    pool = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 160))) for _ in range(30)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 20) :][: rnd.randint(0, 90)] + rnd.choice(alphabet) * rnd.randint(0, 2) for _ in range(4)]
        rows.append((rnd.randint(-5, 500) if i % 9 else None, "".join(parts)))
    rows += [(7, None), (8, ""), (None, None), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    assert fast(df, length=20, gram=6, shard_bytes=2000) == slow(rows, 20)


def test_empty_table(spark):
    assert fast(spark.createDataFrame([], "doc_id long, text string")) == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert fast(df, shard_bytes=100_000) == slow([(r["doc_id"], r["text"]) for r in df.collect()], 100)


def test_many_rows_of_an_id_and_other_ids(spark, monkeypatch):
    """Rows of one id are spread over shards in the order of their texts; ids of any type are ordered."""
    monkeypatch.setattr(substrings, "ID_ROWS", 3)
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("abcdefgh") for _ in range(40)) for _ in range(6)]
    rows = [(rnd.choice([None, 4, 4, 4, 9, i]), "".join(rnd.choice(pool) + rnd.choice("xyz") for _ in range(rnd.randint(0, 4)))) for i in range(70)]
    rows += rows[:9]
    assert fast(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=6, shard_bytes=300) == slow(rows, 20)
    named = [(f"n{i:03d}", t) for i, (_, t) in enumerate(rows)]
    want = {f"n{i:03d}": (n, s) for i, _, n, s, _ in slow([(i, t) for i, (_, t) in enumerate(rows)], 20)}
    got = substrings.repeated(spark.createDataFrame(named, "doc_id string, text string"), length=20, gram=6, shard_bytes=300)
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got.collect()} == want


def test_one_line_in_every_document(spark, monkeypatch):
    """A line between different neighbours: its minimizers are crowded, and so are the cores that end in a neighbour."""
    monkeypatch.setattr(substrings, "CROWD", 20)
    rnd = random.Random(2)
    line = "".join(rnd.choice("abcdefghij ") for _ in range(90))
    rows = [(i, "".join(rnd.choice("klmnop") for _ in range(30)) + line + "".join(rnd.choice("klmnop") for _ in range(30))) for i in range(150)]
    assert fast(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=12, shard_bytes=4000) == slow(rows, 40)
