"""Removal of repeated substrings: every byte covered by a string of `length` bytes that also starts earlier.

Windows of `length` bytes are routed by content: each goes with its minimizer, the gram of `GRAM` bytes with the
smallest hash in it, so equal windows meet whatever documents they stand in. Consecutive windows of one minimizer
travel as one run. Hashes only choose what is compared: a minimizer seen once in the corpus cannot stand in two
equal windows, and its run goes no further. What is left is compared by its bytes: of equal runs a shard of documents sends
one and the exchange keeps one, and the distinct texts of a bucket of minimizers are met by suffix arrays
(Larsson-Sadakane, Kasai), built a shard at a time and merged by binary search. All messages are rows of bounded
size, so their number grows with the text and not with shards times buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table_of, texts
from tessera.llm.components import saved
from tessera.llm.ppm import _B, _B_INV, _LETTER, CHUNK, _power
from tessera.llm.suffixes import repeated_windows

LENGTH = 100
GRAM = 24
SHARD_BYTES = 4 << 20
#: Runs of one minimizer, or pieces of one core, beyond which they are split by content before they meet.
CROWD = 2000
BLOCK = 8
#: Rows of one id beyond which they are spread over shards in the order of their texts (null ids always are).
ID_ROWS = 1000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of the bytes x."""
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[x] * _power(_B, len(x)), dtype=np.uint64, out=sums[1:])
    n = len(x) - gram + 1
    return _mix((sums[gram:] - sums[:n]) * _power(_B_INV, n))


def _leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every window, by the upper half of the hash."""
    n = len(h) - width + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _blocks(docs: list[bytes], length: int):
    """(documents, offsets, texts) of pieces of documents, in order, about CHUNK bytes at a time; a piece overlaps the next of its document by length - 1 bytes."""
    owner, offset, parts, size = [], [], [], 0
    for i, d in enumerate(docs):
        for a in range(0, len(d) - length + 1, CHUNK):
            part = d[a : a + CHUNK + length - 1]
            if size and size + len(part) > CHUNK + length:
                yield owner, offset, parts
                owner, offset, parts, size = [], [], [], 0
            owner.append(i)
            offset.append(a)
            parts.append(part)
            size += len(part)
    if parts:
        yield owner, offset, parts


def runs(docs: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of all documents in order: mark (hash of the minimizer), doc, start, size, lead (bytes before the minimizer). Works on CHUNK bytes at a time, however long a document is."""
    names, kept = ("mark", "doc", "start", "size", "lead"), []
    for owner, offset, parts in _blocks(docs, length):
        x = np.frombuffer(b"".join(parts), dtype=np.uint8)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        firsts = np.cumsum(lengths) - lengths
        h = gram_hashes(x, gram)
        place = _leftmost_minimum(h, length - gram + 1)
        part = np.repeat(np.arange(len(parts)), lengths)
        whole = part[: len(place)] == part[length - 1 : length - 1 + len(place)]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        new &= whole
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
        own = part[starts]
        kept.append((h[place[starts]], np.array(owner)[own], starts - firsts[own] + np.array(offset)[own], stops - starts + length, place[starts] - starts))
    if not kept:
        return {k: np.zeros(0, np.uint64 if k == "mark" else np.int64) for k in names}
    return {k: np.concatenate(v) for k, v in zip(names, zip(*kept, strict=True), strict=True)}


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the stretches of ascending `at` without a gap."""
    cut = np.diff(at) != 1
    return np.flatnonzero(np.concatenate([[True], cut])), np.flatnonzero(np.concatenate([cut, [True]]))


def meeting(strings: list[bytes], length: int) -> np.ndarray:
    """The strings that hold a window whose hash stands at two places; no other string can share a window."""
    if not strings:
        return np.zeros(0, dtype=np.int64)
    x = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    owner = np.repeat(np.arange(len(strings)), lengths)
    whole = np.flatnonzero(owner[: len(x) - length + 1] == owner[length - 1 :])
    h = gram_hashes(x, length)[whole]
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return np.unique(owner[whole[by[twice]]])


def _in_order(docs: DataFrame) -> DataFrame:
    """Adds `seq`: 0, but for rows of null ids and of ids with over ID_ROWS rows their place by text; (doc_id, seq) spreads these over shards and keeps their order."""
    many = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("doc_id").isNull() | (F.col("rows") > ID_ROWS)).select(F.col("doc_id").alias("many"))
    if many.isEmpty():
        return docs.withColumn("seq", F.lit(0).cast("long"))
    on = docs["doc_id"].eqNullSafe(many["many"])
    few = docs.join(many.hint("merge"), on, "left_anti").withColumn("seq", F.lit(0).cast("long"))
    placed = saved(docs.join(many.hint("merge"), on, "left_semi").orderBy("doc_id", "text").withColumn("seq", F.monotonically_increasing_id()))
    return few.union(placed)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = (), texts_out: tuple[str, ...] = ("kept", "kept_text")) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) a row per input row, with the texts named in texts_out and the columns `carry` as the struct `carried`.

    Texts are UTF-8 bytes; a null text is empty. Earlier means smaller doc_id (of any type that sorts), nulls first,
    then by text (so one of two equal rows keeps its text), then by place. Texts shorter than `length` keep
    everything and are never shuffled. `kept` are the bytes left, which may break characters; kept_text leaves the
    broken ones out. Other columns are not read; an empty table gives none.
    """
    docs = docs.select("doc_id", "text", *([F.struct(*carry).alias("carried")] if carry else []))
    id_kind = dict(docs.dtypes)["doc_id"]
    measure = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.where(measure >= length).agg(F.sum(measure)).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    n_buckets = 2 * n_shards
    long_ = _in_order(docs.where(measure >= length))
    sharded = long_.withColumn("shard", F.pmod(F.xxhash64("doc_id", "seq"), F.lit(n_shards)))
    row_kind = f"kind int, bucket long, route long, shard long, doc long, start long, stop long, doc_id {id_kind}, seq long, text binary"

    def opened(table):
        """The shard's rows by age, and their texts."""
        order = pc.sort_indices(table.select(["doc_id", "seq", "text"]), sort_keys=[(c, "ascending") for c in ("doc_id", "seq", "text")], null_placement="at_start")
        data = table.take(order)
        return data, texts(data.column("text"))

    def mark_counts(key, table):
        marks, n = np.unique(runs(opened(table)[1], length, gram)["mark"], return_counts=True)
        return table_of({"mark": marks.view(np.int64), "shard": np.full(len(marks), key[0].as_py()), "n": n}, "mark long, shard long, n long")

    def rows(data, kind, bucket, route, shard, doc, start, stop, text):
        longs = {"bucket": bucket, "route": route, "shard": np.full(len(doc), shard), "doc": doc, "start": start, "stop": stop}
        columns = {"kind": pa.array(kind, pa.int32())} | {n: pa.array(v, pa.int64()) for n, v in longs.items()}
        back = pa.array(doc, pa.int64())
        columns |= {"doc_id": data.column("doc_id").take(back), "seq": data.column("seq").take(back), "text": pa.array(text, pa.binary())}
        return pa.table(columns)

    def settle_shard(key, table, told):
        """Kind 0: spans of runs that stand earlier in the shard. Kind 1: the others whose minimizer has further runs; kind 2: their pieces where it is crowded."""
        data, every = opened(table)
        shard = key[0].as_py()
        marks, totals = (np.asarray(told.column(c).combine_chunks()) if told.num_rows else np.zeros(0, np.int64) for c in ("mark", "total"))
        by = np.argsort(marks.view(np.uint64))
        marks, totals = marks.view(np.uint64)[by], totals[by]
        r = runs(every, length, gram)
        at = np.minimum(np.searchsorted(marks, r["mark"]), max(len(marks) - 1, 0))
        chosen = np.flatnonzero(marks[at] == r["mark"]) if len(marks) else np.zeros(0, np.int64)
        mark, doc, start, size, lead = (r[c][chosen] for c in ("mark", "doc", "start", "size", "lead"))
        _, group, count = np.unique(mark, return_inverse=True, return_counts=True)
        n = size - length + 1
        # Of runs with the same bytes the oldest goes on, the others are gone whole; the table compares bytes, not only hashes.
        oldest: dict[bytes, int] = {}
        text = [every[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), (start + size).tolist(), strict=True)]
        lone = np.fromiter((oldest.setdefault(t, i) == i for i, t in enumerate(text)), dtype=bool, count=len(text))
        gone = np.flatnonzero(~lone)
        follows = (doc[gone][1:] == doc[gone][:-1]) & (start[gone][1:] == (start + n)[gone][:-1])
        a, b = (gone[np.flatnonzero(c)] if len(gone) else gone for c in (np.concatenate([[True], ~follows]), np.concatenate([~follows, [True]])))
        spans = (doc[a], start[a], start[b] + size[b])
        # A minimizer that has one text and stands nowhere else is settled.
        texts_here = np.bincount(group, weights=lone, minlength=len(count))[group]
        on = np.flatnonzero(lone & ((totals[at[chosen]] > count[group]) | (texts_here > 1)))
        crowded = totals[at[chosen]][on] > CROWD
        plain = on[~crowded]
        out = [(plain * 0 + 1, (_mix(mark[plain]) % np.uint64(n_buckets)).astype(np.int64), mark[plain].view(np.int64), doc[plain], start[plain], (start + size)[plain])]
        pieces, piece_text = [], []
        for i in on[crowded].tolist():
            # Windows are split by how far before the minimizer they start; those of a block share all but BLOCK - 1 bytes, which give the route.
            gram_at, last = int(lead[i]), int(lead[i] - n[i]) + 1
            for k in range(last // BLOCK, gram_at // BLOCK + 1):
                p, q = gram_at - min(gram_at, k * BLOCK + BLOCK - 1), gram_at - max(last, k * BLOCK) + length
                core = text[i][gram_at - k * BLOCK : gram_at - k * BLOCK - BLOCK + 1 + length]
                route = xxhash.xxh64_intdigest(core, seed=(int(mark[i]) + k) & 0xFFFFFFFFFFFFFFFF)
                piece = text[i][p:q]
                pieces.append((2, xxhash.xxh64_intdigest(piece) % n_buckets, route - (1 << 64) * (route >> 63), doc[i], start[i] + p, start[i] + q))
                piece_text.append(piece)
        out.append(np.array(pieces, dtype=np.int64).reshape(-1, 6).T)
        kind, bucket, route, who, begin, end = (np.concatenate(c) for c in zip(*out, strict=True))
        own_spans = np.arange(len(spans[0]))
        return rows(
            data,
            np.concatenate([own_spans * 0, kind]),
            np.concatenate([own_spans % n_buckets, bucket]),
            np.concatenate([own_spans * 0, route]),
            shard,
            *(np.concatenate(p) for p in zip(spans, (who, begin, end), strict=True)),
            [None] * len(own_spans) + [text[i] for i in plain.tolist()] + piece_text,
        )

    def settle_bucket(table):
        """Removed spans: kind 0 as they are, texts that stand earlier in another shard, and what the suffix arrays find between the distinct texts."""
        shard, doc, start, stop, kind = (np.asarray(table.column(c).combine_chunks()) for c in ("shard", "doc", "start", "stop", "kind"))
        lead = np.asarray(table.column("lead").combine_chunks().cast(pa.int8())) > 0
        # A route with one text is settled: its rows are that text's copies.
        mine = np.flatnonzero((kind > 0) & lead)
        _, group, count = np.unique(np.asarray(table.column("route").combine_chunks())[mine], return_inverse=True, return_counts=True)
        compared = mine[count[group] > 1]
        compared = compared[meeting(texts(table.column("text").take(pa.array(compared))), length)]
        out = [np.stack([c[(kind == 0) | ~lead] for c in (shard, doc, start, stop)])]
        some = table.select(["doc_id", "seq", "doc", "start"]).take(pa.array(compared))
        strings = texts(table.column("text").take(pa.array(compared)))
        order = np.asarray(pc.sort_indices(some, sort_keys=[(c, "ascending") for c in some.column_names], null_placement="at_start"))
        ids = pa.Table.from_arrays([some.column(c).take(pa.array(order)) for c in ("doc_id", "seq", "doc")], names=["a", "b", "c"])
        change = np.zeros(len(order), dtype=bool)
        for c in ids.columns:
            flat = c.combine_chunks().dictionary_encode(null_encoding="encode").indices
            change[1:] |= np.diff(np.asarray(flat)) != 0
        age = np.zeros(len(order), dtype=np.int64)
        # Ages of documents leave room for every place, which decides inside a document.
        age[order] = np.cumsum(change).astype(np.int64) << 36
        begin = start[compared]
        for i, w in zip(range(len(strings)), repeated_windows(strings, age + begin, length), strict=True):
            if len(w):
                a, b = _stretches(w)
                part = np.empty((4, len(a)), dtype=np.int64)
                part[0], part[1], part[2], part[3] = shard[compared[i]], doc[compared[i]], begin[i] + w[a], begin[i] + w[b] + length
                out.append(part)
        found = np.concatenate(out, axis=1)
        return table_of(dict(zip(("shard", "doc", "start", "stop"), found, strict=True)), "shard long, doc long, start long, stop long")

    def led(pieces):
        """Marks one row of each text of a route, the oldest; a shard sends a text once at most, so no text has more rows than there are shards."""
        age = F.struct("doc_id", "seq", "doc", "start", "shard", "stop")
        oldest = F.min(age).over(Window.partitionBy("bucket", "route", "text"))
        return pieces.withColumn("lead", (F.col("kind") == 0) | age.eqNullSafe(oldest))

    def settle(pieces):
        return led(pieces).groupBy("bucket").applyInArrow(settle_bucket, "shard long, doc long, start long, stop long")

    def remove(table, found):
        data, every = opened(table)
        spans = np.stack([np.asarray(found.column(c).combine_chunks()) if found.num_rows else np.zeros(0, np.int64) for c in ("doc", "start", "stop")], axis=1)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        bounds = np.searchsorted(spans[:, 0], np.arange(len(every) + 1))
        columns = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *texts_out)}
        for i, text in enumerate(every):
            parts, past, count, end = [], 0, 0, -1
            for _, a, b in spans[bounds[i] : bounds[i + 1]].tolist():
                if a > end:
                    count += 1
                    parts.append(text[past:a])
                elif b <= end:
                    continue
                end = past = b
            parts.append(text[past:])
            kept = b"".join(parts)
            columns["n_bytes"].append(len(text))
            columns["n_removed"].append(len(text) - len(kept))
            columns["n_spans"].append(count)
            columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if "kept" in texts_out:
                columns["kept"].append(kept)
            if "kept_text" in texts_out:
                columns["kept_text"].append(kept.decode("utf-8", "ignore"))
        out = table_of(columns, digests).add_column(0, "doc_id", data.column("doc_id"))
        return out.append_column("carried", data.column("carried")) if carry else out

    kinds = {"kept": "binary", "kept_text": "string"}
    digests = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {t} {kinds[t]}" for t in texts_out)
    schema = f"doc_id {id_kind}, {digests}" + (f", carried {dict(docs.dtypes)['carried']}" if carry else "")
    counted = sharded.groupBy("shard").applyInArrow(mark_counts, "mark long, shard long, n long")
    told = counted.withColumn("total", F.sum("n").over(Window.partitionBy("mark"))).where("total > 1").select("shard", "mark", "total")
    sent = sharded.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(settle_shard, row_kind).repartition("bucket")
    # Filters on generated columns stay behind the exchange, and all branches use all columns, so all read the same one.
    made = F.explode(F.array(F.struct("kind", "route"))).alias("made")
    sent = sent.select(*[c for c in sent.columns if c not in ("kind", "route")], made).select("*", "made.*").drop("made")
    crowded = led(sent.where("kind = 2"))
    distinct = crowded.where("lead")
    cores = distinct.groupBy("route").agg(F.count("*").alias("pieces")).where(F.col("pieces") > CROWD)
    split = distinct.join(cores.hint("merge"), "route", "left")
    shift = F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("stop") - F.col("start") - length)))
    split = split.withColumn("shift", shift).withColumn("start", F.col("start") + F.col("shift"))
    split = split.withColumn("text", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(F.substring("text", F.col("shift").cast("int") + 1, F.lit(length))))
    split = split.withColumn("stop", F.col("start") + F.octet_length("text")).withColumn("route", F.when(F.col("pieces").isNull(), F.col("route")).otherwise(F.xxhash64("text")))
    split = split.withColumn("bucket", F.pmod(F.xxhash64("route"), F.lit(n_buckets))).repartition("bucket")
    spans = ["shard", "doc", "start", "stop"]
    found = settle(sent.where("kind < 2")).union(crowded.where("not lead").select(*spans)).union(settle(split))
    cleaned = sharded.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(remove, schema)
    text = F.coalesce("text", F.lit(""))
    kept = {"kept": text.cast("binary").alias("kept"), "kept_text": text.alias("kept_text")}
    short = docs.where(measure < length).select(
        "doc_id", measure.cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
        *[kept[t] for t in texts_out], *(["carried"] if carry else []),
    )
    return cleaned.union(short)
