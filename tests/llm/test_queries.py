"""The registered queries against plain versions of their contracts, on whole small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import langid, ppm, queries, toxicity
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_texts import SF, slow_ppm

SF2 = "/root/testdata/sf0.01"


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_columns(spark):
    first = {
        "op1_substring_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op2_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3_language_id": "doc_id held_out lang_pred score", "op7_simhash": "doc_id fingerprint component_id", "op10_toxicity": "doc_id held_out score predicted",
        "op6_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    made = queries.queries()
    for name, columns in first.items():
        got = made[name](spark, SF).columns
        assert got[: len(columns.split())] == columns.split() and set(queries.oracle_sql()) <= set(made)


def test_lm_score(spark, docs):
    ids = sorted(docs)
    learn = [crc(i, 7) != 2 for i in ids]
    texts = [(docs[i] or "").encode() for i in ids]
    tokens = [[*t.lower().split(), b"\n"] for t in texts]
    counts = Counter(w for t, y in zip(tokens, learn) if y for w in t)
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, y, t, s in zip(ids, learn, tokens, slow_ppm(texts, learn, ppm.ORDER, 1)):
        want[i] = (not y, len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), s)
    for r in queries.op2_lm_score(spark, SF).collect():
        assert tuple(r)[1:] == pytest.approx(want.pop(r["doc_id"]), rel=1e-5)
    assert not want


def slow_language(model, text):
    """The hierarchy's decision from n-grams counted one by one."""
    raw = b" " + text.lower().encode() + b" "
    x = np.zeros(model.weights.shape[1])
    for k, order in enumerate(langid.ORDERS):
        found = Counter((int.from_bytes(raw[i : i + order], "big") * 2654435761 % (1 << 32)) >> 19 for i in range(len(raw) - order + 1))
        size = math.sqrt(sum(math.log1p(c) ** 2 for c in found.values()))
        for h, c in found.items():
            x[k * langid.BUCKETS + h] = math.log1p(c) / size
    margin = {p: float(w @ x) + b for p, w, b in zip(model.pairs, model.weights.astype(float), model.bias)}

    def winner(level, names):
        signed = lambda a, b: margin[(level, a, b)] if (level, a, b) in margin else -margin[(level, b, a)]
        rank = {a: [signed(a, b) for b in names if b != a] for a in names}
        best = max(names, key=lambda a: (sum(m > 0 for m in rank[a]), sum(rank[a])))
        return best, 1 / (1 + math.exp(-4 * min(rank[best]))) if rank[best] else 1.0

    family, sure = winner("family", model.families)
    lang, inside = winner(family, model.members[family])
    return lang, sure * inside


def test_language_id(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    for r in queries.op3_language_id(spark, SF).collect():
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0)
        t = docs[r["doc_id"]]
        want = slow_language(model, t) if t and any(c.isalpha() for c in t) else ("und", 0.0)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=2e-3)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF2}/documents.parquet").where("lang is not null").collect()}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in queries.op3_language_id(spark, SF2).where("held_out").collect() if r["doc_id"] in lang]
    assert np.mean(right) > 0.97


def slow_kernel(a, b):
    """Common subsequences by dynamic programming, letter by letter, from the recursion's definition."""
    d, p = toxicity.DECAY, toxicity.ORDER

    def raw(s, t):
        prime = [[1.0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for _ in range(p - 1):
            nxt = [[0.0] * (len(t) + 1) for _ in range(len(s) + 1)]
            for i in range(1, len(s) + 1):
                for j in range(1, len(t) + 1):
                    nxt[i][j] = d * nxt[i - 1][j] + sum(prime[i - 1][k - 1] * d ** (j - k + 2) for k in range(1, j + 1) if t[k - 1] == s[i - 1])
            prime = nxt
        return sum(d * d * prime[i][j] for i in range(len(s)) for j in range(len(t)) if s[i] == t[j])

    return raw(a, b) / max(math.sqrt(raw(a, a) * raw(b, b)), 1e-9)


def test_toxicity(spark, docs):
    labels = {r["doc_id"]: int(r["toxic"]) for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, SF2).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(held) > 0.9
    table, judged = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(table.select("doc_id", "text"), judged.select("doc_id", "toxic").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, SF).collect()}
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[2:9]:
        units = toxicity.units(docs[i] or "")
        margins = [max((sum(w * slow_kernel(s, m) for w, m in zip(model.weights, model.marks)) if model.marks else 0) + model.bias for s in toxicity.stretches(u)) for u in units]
        assert got[i] == pytest.approx(model.probability(margins, list(units.values())), abs=1e-3)


def test_simhash(spark, docs):
    fp = {i: slow_fingerprint(t) for i, t in docs.items()}
    root = slow_components(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()} == {i: (f"{fp[i]:016x}", root[i]) for i in docs}


def test_packing(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.items()}
    rows, ends, covered = queries.op9_packing(spark, SF).collect(), {}, Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["length"], r["doc_tokens"], r["ids_crc32"]) == (len(own), len(ids[r["doc_id"]]), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert max(ends.values()) <= 2048 and set(covered.values()) == {1} and covered.total() == sum(map(len, ids.values()))
    assert covered.total() > 0.97 * 2048 * len(ends)
