"""The pipeline against brute force, and its parts removed."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_substrings import slow
from tests.llm.test_texts import shingles


def brute(docs, items):
    """Ids and texts that reach the packing stage."""
    rows = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    fp = {i: slow_fingerprint(t) for i, t in rows.items()}
    root = slow_components(sorted(rows), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    seen, kept = set(), {}
    for i in sorted(rows):
        raw = rows[i].encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(raw[a : a + 100])
        left = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if left.split():
            kept[i] = left
    bad = {i for i, t in kept.items() for _, x in items if shingles(x) and len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x))}
    return {i: t for i, t in kept.items() if i not in bad}


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items, shared = [(i, text(30)) for i in range(5)], text(60)
    docs = [(i, text(rnd.randint(20, 150))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(6)] + [(200 + i, docs[i][1] + " more") for i in range(6)]
    docs += [(300 + i, f"{text(30)} {shared} {text(30)}") for i in range(8)] + [(400 + i, f"{text(40)} {items[i % 5][1]} {text(9)}") for i in range(8)]
    docs += [(500, None), (501, ""), (502, "12 ! 34"), (503, shared)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, rnd.choice(["en", "de"]), "s", len(t or ""), "extra") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, shard string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want, now = brute(docs, items), spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}-{name}")
        now = spark.read.parquet(f"{folder}/{k}-{name}")
        assert now.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want and 300 in want and 400 not in want
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(want)


def test_leaks_without_an_id_go(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, f"so {item} it", "en", "s", 1), (1, f"then {item} on", "en", "s", 1), (2, "clean words only", "en", "s", 1)]
    left = lambda r: [x["doc_id"] for x in corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(r, kind), str(tmp_path)).collect()]
    assert left(rows) == [2] and sorted(left([(None, "clean too", "en", "s", 1), *rows[1:]]), key=str) == [2, None]


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_slow_is_itself():
    assert slow([(1, "ab" * 60), (2, None)], 100)[0][0] == 1


def test_null_ids_repeats_and_ties(spark, tmp_path):
    """Rows without an id stay apart by their texts, equal rows leave one, rows of one id go their own ways."""
    rnd = random.Random(6)
    text = lambda: " ".join("".join(rnd.choice("etaoinshrdlucm") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, None), (1, c), (1, c), (2, d), (2, e), (2, ""), (3, d), (None, a)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, text()), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise(F.lit("de")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted([(None, a), (None, b), (1, c), (2, d), (2, e)], key=str)
