"""The operators that judge every document alone, against plain versions of their definitions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import chat, decontaminate, langid, packing, ppm, quality, template, tokencount, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "one", "a\x0bb\x0cc\rd", "é " * 30, "x" * 20_000, "w " * 9_000, "  a\xa0b", "</s>[INST] \\ <|end|> \\<|end|>", "<|endoftext|> hi <|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with the results'."""
    rows = [(i, t, "x", 1.5) for i, t in enumerate(ODD)] + [(None, "some words here", None, None), (3, "one", "x", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double")


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


def slow_quality(t):
    w, t = words(t), t or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, odd):
    texts = [t for t in ODD if len(t or "") < 5000] + ["a b c d e f a b c d e g\nx\nx\n", "q w e r t q w e r t q w e r t | # $"]
    for t in texts:
        m = quality.measure((t or "").encode())
        assert (m[0], m[1], m[2], m[4], m[5]) == slow_quality(t), t
    rows = quality.ledger(odd)
    assert rows.count() == odd.count() and quality.ledger(odd.limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_policy(rows, quality.BASE).collect()}
    assert not kept[0] and not kept[7] and kept[5] is False
    shown = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(rows, quality.POLICIES["web-1"]).collect()}
    masks = [r["failed"] for r in rows.collect()]
    assert shown == {n: (sum(bool(m & b) for m in masks), sum(m == b for m in masks)) for n, b in quality.BIT.items()}


def greedy(word, starts, rest):
    n, at = 0, 0
    while at < len(word):
        pool = starts if at == 0 else rest
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_token_counts_are_greedy(spark, odd):
    starts, rest = {b"a", b"ab", b"abcd"}, {b"b", b"c", b"cd", b"bcx", b"d"}
    machine = tokencount.Automaton(starts, rest)
    for n in range(1, 7):
        for w in itertools.product(b"abcdx", repeat=n):
            assert machine.count(bytes(w)) == greedy(bytes(w), starts, rest)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    s, r = map(set, tokencount.split_rank_file(path))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(25)
    want = {d["doc_id"]: sum(greedy(b" " + w, s, r) for w in words(d["text"])) for d in docs.collect()}
    assert {d["doc_id"]: d["n_tokens"] for d in tokencount.token_counts(docs, path).collect()} == want
    got = tokencount.token_counts(odd, ("a", "on", "##e", "wor"), "##")
    assert got.count() == odd.count() and [x["n_unknown"] for x in got.where("doc_id = 3").collect()] == [0, 0]


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id")
    rows = got.select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    found = langid.identify(odd, model).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (0, 1, 2)} == {"und"} and len(found) == odd.count()
    assert langid.identify(odd, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.accepted(odd, model).columns == odd.columns


def test_language_sample_is_300_rows(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "Hierarchy", lambda langs, x, y: taken.extend(y))
    langid.fit(spark.range(1200).selectExpr("id as doc_id", "concat('some text ', id) as text", "if(id < 800, 'en', 'de') as lang"))
    assert (taken.count("en"), taken.count("de")) == (300, 300)


def test_escapes_are_reversible_and_hide_controls():
    for parts in itertools.product(["<", "</s>", "s>[INST]", "\\", "|end|>", "<|turn|>", "é"], repeat=4):
        t = "".join(parts)
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|end|>\\b"), (1, 1, "assistant", None), (2, 5, None, "\n"), (None, 0, "assistant", "é"), (1, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    full = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    for k, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        group = list(group)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group)
        loss = "".join(r[3] or "" for r in group if r[2] == "assistant")
        assert got[k]["n_turns"] == len(group) and got[k]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[k]["loss_chars"] == len(loss)
        text = full[k]["formatted"]
        assert got[k]["formatted_chars"] == len(text)
        assert "".join(chat.unescape(text[s["start"] : s["end"]]) for s in full[k]["loss_spans"]) == loss
    assert chat.digests(df.limit(0)).count() == 0


def test_template_language():
    t = template.Template("{% for m in ms %}{% if loop.first %}[{% elif m.x > 1 + 1 and not m.y %}{{ m.x * 2 }}{% else %}{{ m.z | default('-') | upper }}{% endif %}{% if loop.last %}]{% endif %}{% endfor %}")
    assert t.render(ms=[{}, {"x": 3}, {"x": 1, "z": "q"}])[0] == "[6Q]"
    assert template.Template("{{ 'a' ~ 1 + 2 }}{% if 1 == 2 %}x{% else %}y{% endif %}{# note #}").tree == [("text", "a3y")]
    assert template.Template("a{% generation %}b{{ c }}{% endgeneration %}d").render(c="e") == ("abed", [(1, 3)])
    assert template.Template("{{ ''.__class__ }}{{ x.y.z }}").render(x=3)[0] == ""
    for bad in ("{{ f() }}", "{{ a | nope }}", "{% for x %}{% endfor %}", "{% if 1 %}", "{{ 1 + }}", "{% import os %}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)


def shingles(t):
    w = words((t or "").lower() if (t or "").isascii() else t)
    w = [x.lower() for x in w]
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination(spark, odd):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    long = ("filler " * 4000).split()
    docs = [(1, item.upper()), (2, " ".join([*long, *item.split()[:-2], *long])), (3, " ".join(item.split()[:8])), (4, "short one"), (5, None), (6, item), (6, item)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, item), (11, "short one"), (12, None), (13, " "), (10, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contaminated(df, items).collect())
    want = sorted((d, i, len(shingles(t) & shingles(x))) for d, t in docs for i, x in ((10, item), (11, "short one")) if shingles(t) and len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)))
    assert got == want and decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(df.limit(0), items).count() == 0
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0


def test_packing(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(odd, path).collect()
    ids = {}
    for d in odd.collect():
        ids.setdefault(d["doc_id"], []).append([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1])
    for r in rows:
        own = ids[r["doc_id"]][0]
        part = np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(own) and r["length"] <= 2048
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048 and packing.pack(odd.limit(0), path).count() == 0


def test_packing_plan():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        hist = {int(n): int(c) for n, c in zip(rnd.integers(1, 65, 20), rnd.integers(1, 500, 20))}
        plan = packing.plan(hist, 64)
        seen = {}
        for lengths, count in plan:
            assert sum(lengths) <= 64 and count > 0
            for n in lengths:
                seen[n] = seen.get(n, 0) + count
        assert seen == hist


def test_string_kernel():
    def slow(a, b, p=3, decay=0.6):
        places = lambda s: itertools.combinations(range(len(s)), p)
        return sum(decay ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in places(a) for j in places(b) if all(a[x] == b[y] for x, y in zip(i, j)))

    left, right = ["idiot", "ixdxiot", "loweient", "ab", "catacat", "éàü"], ["idiot", "lowei", "taca", "disgusting", "éàüé"]
    want = [[slow(a, b) / max((slow(a, a) * slow(b, b)) ** 0.5, 1e-9) for b in right] for a in left]
    assert np.abs(toxicity.kernel(left, right) - want).max() < 1e-5


def test_words_are_judged_by_their_own_subsequences(monkeypatch):
    """The landmarks' weights are added up by subsequence once, so no word meets a landmark; alphabets too large for that go by the kernel."""
    rnd = random.Random(4)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 25)))
    marks, words = [word("abcdé") for _ in range(9)] + ["ab"], [word("abcdéfg日") for _ in range(300)] + [""]
    weights = np.array([rnd.uniform(-2, 2) for _ in marks], dtype=np.float32)
    want = toxicity.kernel(words, marks) @ weights + np.float32(0.25)
    model = toxicity.Model(marks, weights, 0.25)
    with monkeypatch.context() as m:
        m.setattr(toxicity, "kernel", None)
        assert np.abs(model.margins(words) - want).max() < 1e-4
    monkeypatch.setattr(toxicity, "DENSE", 10)
    assert np.abs(toxicity.Model(marks, weights, 0.25).margins(words) - want).max() < 1e-4


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"), sample=300)
    rows = toxicity.score(docs.join(labels.where("doc_id % 5 = 0").select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    right = [(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]
    assert np.mean(right) > 0.95
    assert model.probability(*zip(*[(m, 1) for m in model.margins(list(toxicity.units("you i-d-i-o-t " * 3)))])) > 0
    found = toxicity.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).count() == odd.count()


def test_spelled_runs_are_judged_to_their_end():
    alphabet = "qwertyuopasdfghjklzxcvbnm"
    toxic = [({w: 1, "idiot": 1}, 1) for w in ("some", "words", "here", "there")]
    model = toxicity.train(toxic + [({w: 1, v: 1}, 0) for w in ("some", "words", "here", "there") for v in ("plain", "clean", "kind")])
    top = lambda t: max(model.margins(list(toxicity.units(t))))
    for filler in ("a " * 30, " ".join((alphabet * 2)[:30]) + " ", " ".join((alphabet * 9)[:200]) + " "):
        assert top(filler) < 0 < top(filler + "i d i o t") and top(filler + "i d i o t " + filler) > 0
    for n in range(3, 90):
        got = list(toxicity.units(" ".join(s := (alphabet * 4)[:n])))
        assert all(any(s[i : i + 13] in u.replace(" ", "") for u in got) for i in range(max(1, n - 12)))


def test_every_frequent_insult_becomes_a_landmark():
    rnd = np.random.default_rng(5)
    word = lambda: "".join(rnd.choice(list("etaoinshrdlubcmk"), 8))
    insults, plain = [word() for _ in range(40)], [word() for _ in range(300)]
    some = lambda: {str(w): 1 for w in rnd.choice(plain, 6)}
    model = toxicity.train([(some() | {w: 1}, 1) for w in insults for _ in range(40)] + [(some(), 0) for _ in range(1600)])
    assert set(insults) <= set(model.marks) and (model.margins(insults) > 0).all() and (model.margins(plain) < 0).mean() > 0.95


def slow_ppm(texts, learn, order, least):
    """log10 probabilities by dictionaries, symbol by symbol."""
    tables = [{} for _ in range(order + 1)]
    for t in (ppm.normal(x) for x, y in zip(texts, learn) if y):
        s = b"\n" * order + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen = tables[k].setdefault(s[i - k : i], {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    out = []
    for t in map(ppm.normal, texts):
        s, total = b"\n" * order + t, 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = tables[k].get(s[i - k : i], {})
                if sum(seen.values()) < (least if k else 1):
                    continue
                left = {c: n for c, n in seen.items() if c not in gone}
                if not left:
                    continue
                n = sum(left.values())
                if s[i] in left:
                    total += np.log10((left[s[i]] - 0.5) / n)
                    break
                total += np.log10(len(left) / (2 * n))
                gone |= set(seen)
            else:
                total += np.log10(1 / (256 - len(gone)))
        out.append(total)
    return out


def test_ppm(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()] + [(1000, None), (1001, "Zz\x0b\x0cqq"), (1001, "")]
    texts = [(t or "").encode()[:3000].decode("utf-8", "ignore") for _, t in rows]
    df = spark.createDataFrame([(i, t, 0.0) for (i, _), t in zip(rows, texts)], "doc_id long, text string, score double")
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    want = slow_ppm([t.encode() for t in texts], learn, ppm.ORDER, ppm.LEAST)
    counts = {}
    for t, y in zip(texts, learn):
        for w in [*words(t.encode().lower().decode()), b"\n"] if y else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = ppm.score(df, shard_bytes=8000).collect()
    key = lambda x: (x[0], x[1])
    wanted = sorted(((i, len(t.encode().lower().split()) + 1, s, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*t.encode().lower().split(), b"\n"])) for (i, _), t, s in zip(rows, texts, want)), key=key)
    for r, w in zip(sorted(((r["doc_id"], r["n_tokens"], r["score"], r["base_score"]) for r in got), key=key), wanted, strict=True):
        assert r == pytest.approx(w, rel=1e-5)
    assert ppm.score(odd).count() == odd.count() and ppm.score(odd.limit(0)).count() == 0


def test_decontamination_beyond_broadcast(spark, monkeypatch, odd):
    """The way for sketches of any size finds what the way for small ones finds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    own = docs.select((docs.doc_id + 10_000).alias("item_id"), docs.text.substr(1, 400).alias("text")).where("item_id % 9 = 1")
    items, docs = items.union(own).union(items.limit(3)), docs.union(odd.select("doc_id", "text")).union(docs.limit(5)).union(docs.limit(4).selectExpr("cast(null as long)", "text"))
    result = lambda: sorted(map(tuple, decontaminate.contaminated(docs, items).collect()), key=str)
    small = result()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert result() == small and len(small) > 10 and any(r[0] is None for r in small)


def test_ppm_in_parts_and_groups(spark, monkeypatch):
    """Neither cutting long texts into parts nor summing by groups of shards changes a score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(docs.limit(2)).union(docs.limit(2).selectExpr("cast(null as long)", "text")).union(docs.limit(1).selectExpr("doc_id", "concat(repeat('x', 3000), ' ', text)"))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    whole = sorted(ppm.score(docs).collect(), key=key)
    monkeypatch.setattr(ppm, "CHUNK", 700)
    monkeypatch.setattr(ppm, "GROUP", 2)
    parts = sorted(ppm.score(docs, shard_bytes=20_000).collect(), key=key)
    for a, b in zip(whole, parts, strict=True):
        assert a["doc_id"] == b["doc_id"] and tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-6)


def test_packing_groups(spark, odd):
    """Few or many ranking groups: the same pieces, no gap, little padding."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).union(odd.selectExpr("cast(null as long)", "text"))
    piece = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    one, many = packing.pack(docs, path).collect(), packing.pack(docs, path, ranked=7).collect()
    assert sorted(map(piece, one)) == sorted(map(piece, many))
    for rows in (one, many):
        ends = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert ends.get(r["sequence_id"], 0) == r["offset"]
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 2048
        assert len(ends) == -(-sum(r["length"] for r in rows) // 2048)
