"""Language-model scoring by prediction by partial matching over bytes.

Texts are read as their lower-cased (A-Z) words, one space between words and an end symbol; contexts reach over
word and document starts. The context trie is the table of all context-and-symbol strings of the training rows.
It may outgrow any machine, so it stays in hash buckets of its last three context bytes, beside the counts of all
strings of three bytes, which are bounded. Shards of documents ask the buckets for the strings they hold and get
their code lengths back. A bucket's counts are summed by groups of shards first, and every group is answered by
itself, so a common context grows with its distinct strings and never with the shards that ask for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, pack, pack_sorted, split_bucket, table_of, texts, unpack, unpack_sorted

ORDER = 5
END = 10  # no word holds a line feed
SHARD_BYTES = 8 << 20
CHUNK = 1 << 18
LEAST = 1  # a context seen less often is passed over for a shorter one; 1 passes over none
BUCKETS = 4096  # buckets at most: a shard sends that many messages at most
GROUP = 256  # shards whose questions meet in one task
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}
_SPACED = bytes(32 if i in SPACES else i for i in range(256))


def normal(text: bytes) -> bytes:
    if len(text) < CHUNK:
        return b" ".join(text.lower().split()) + b"\n"
    spaced = text.lower().translate(_SPACED)  # a list of the words of a long text would take ten times its bytes
    while b"  " in spaced:
        spaced = spaced.replace(b"  ", b" ")
    return spaced.strip(b" ") + b"\n"


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        a = np.full(size, base, dtype=np.uint64)
        a[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(a)
    return have[:n]


def parts_of(docs: list[bytes], order: int):
    """(documents, contexts, parts) of about CHUNK bytes: normal texts in order, long ones cut behind a space, each part with the `order` bytes before it."""
    owner, lead, parts, size = [], [], [], 0
    for i, d in enumerate(docs):
        a = 0
        while a < len(d):
            b = len(d)
            if b - a > CHUNK:
                b = d.rfind(b" ", a, a + CHUNK) + 1 or d.find(b" ", a + CHUNK) + 1 or len(d)
            if size and size + b - a > CHUNK:
                yield np.array(owner), lead, parts
                owner, lead, parts, size = [], [], [], 0
            owner.append(i)
            lead.append((bytes([END]) * order + d[max(a - order, 0) : a])[-order:] if order else b"")
            parts.append(d[a:b])
            size += b - a
            a = b
    if parts:
        yield np.array(owner), lead, parts


def grams(lead: list[bytes], parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context-and-symbol strings of the parts behind their contexts, symbol lowest, and each part's first place."""
    x = np.frombuffer(b"".join(c + p for c, p in zip(lead, parts, strict=True)), dtype=np.uint8)
    key = np.zeros(len(x) - order, dtype=np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | x[k : len(x) - order + k]
    lengths = np.array([len(d) for d in parts])
    starts = np.cumsum(lengths + order) - lengths - order
    if order:
        keep = np.ones(len(key), dtype=bool)
        for k in range(order):  # places that only lead up to the next part
            keep[starts[1:] - order + k] = False
        key = key[keep]
    return key, np.cumsum(lengths) - lengths


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, and the number of words of each part."""
    x = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[x] * _power(_B, len(x)), dtype=np.uint64)])
    ends = np.flatnonzero((x == 32) | (x == END))
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = ends > starts
    s, e = starts[full], ends[full]
    h = (sums[e] - sums[s]) * _power(_B_INV, len(x))[s]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    bounds = np.cumsum([len(d) for d in parts])
    counts = np.diff(np.searchsorted(e, bounds, side="left"), prepend=0)
    return h, counts


def _counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at], np.diff(at, append=len(sorted_keys))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counted key lists."""
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def inventory(docs: list[bytes], learn: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind (0 strings, 1 words): the shard's distinct keys, ascending, and their counts in learned documents."""
    kept: dict[int, list] = {0: [], 1: []}
    for owner, lead, parts in parts_of(docs, order):
        for wanted in (True, False):
            some = np.flatnonzero(learn[owner] == wanted).tolist()
            if some:
                mine = [parts[i] for i in some]
                for kind, keys in ((0, grams([lead[i] for i in some], mine, order)[0]), (1, word_hashes(mine)[0])):
                    k, c = _counted(np.sort(keys))
                    kept[kind].append((k, c if wanted else np.zeros_like(c)))
    return {kind: _merge(p) for kind, p in kept.items()}


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Strings go by their three latest context bytes, words by their hash."""
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF) if kind == 0 else keys
    return (((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def code_lengths(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray], order: int, least: int = LEAST) -> np.ndarray:
    """log10 probabilities of ascending `asked` strings under the trie of the training strings `keys`.

    Escapes follow method D: half a count is taken from every symbol of a context and given to the escape. After
    an escape, symbols seen in the longer context are excluded. Contexts seen fewer than `least` times are not
    tried: a longer context is seen no more often than its shorter ones, so only the longest are passed over.
    Orders 3 and up come from the bucket's own strings, orders 2 to 0 from `triples`, all strings of three bytes
    in order and their counts.
    """
    levels = {order: (keys, counts.astype(np.float64))}
    for k in range(order - 1, 2, -1):
        upper = levels[k + 1]
        levels[k] = _merge([(upper[0] & np.uint64((1 << 8 * (k + 1)) - 1), upper[1])])
    levels[2] = (triples[0], triples[1].astype(np.float64))
    for k in (1, 0):
        upper = levels[k + 1]
        levels[k] = _merge([(upper[0] & np.uint64((1 << 8 * (k + 1)) - 1), upper[1])])
    out = np.zeros(len(asked), dtype=np.float64)
    open_ = np.ones(len(asked), dtype=bool)
    above_q = above_x = None  # by asked string: symbols excluded, and their count at this level
    for k in range(order, -1, -1):
        g, c = levels[k]
        part = asked & np.uint64((1 << 8 * (k + 1)) - 1)
        contexts, first = np.unique(g >> np.uint64(8), return_index=True)
        n = np.add.reduceat(c, first) if len(first) else np.zeros(0)
        q = np.diff(first, append=len(g)).astype(np.float64)
        ctx = part >> np.uint64(8)
        at = np.minimum(np.searchsorted(contexts, ctx), max(len(contexts) - 1, 0))
        known = contexts[at] == ctx if len(contexts) else np.zeros(len(ctx), bool)
        n_ctx, q_ctx = (np.where(known, v[at], 0.0) if len(contexts) else np.zeros(len(ctx)) for v in (n, q))
        used = n_ctx >= (least if k else 1)
        left_n, left_q = (n_ctx, q_ctx) if above_q is None else (n_ctx - above_x, q_ctx - above_q)
        where = np.minimum(np.searchsorted(g, part), max(len(g) - 1, 0))
        seen = g[where] == part if len(g) else np.zeros(len(part), bool)
        some = used & (left_q > 0.5)
        hit = open_ & seen & some
        out[hit] += np.log10((c[where[hit]] - 0.5) / left_n[hit])
        escape = open_ & ~seen & some
        out[escape] += np.log10(left_q[escape] / (2 * left_n[escape]))
        open_ &= ~hit
        if k:
            lower_g, lower_c = levels[k - 1]
            below = lower_c[np.searchsorted(lower_g, g & np.uint64((1 << 8 * k) - 1))] if len(g) else np.zeros(0)
            x = np.add.reduceat(below, first) if len(first) else np.zeros(0)
            above_x = np.where(used, x[at], 0.0) if len(contexts) else np.zeros(len(ctx))
            above_q = np.where(used, q_ctx, 0.0)
    rest = 256 - len(levels[0][0])
    out[open_] += np.log10(1 / max(rest, 1))
    return out


def statistics(docs: DataFrame, learned) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """Counts of all strings of three bytes of the learned rows, their tokens and distinct tokens.

    At most 2^24 strings exist, which bounds what reaches the driver; words are counted apart and only their sums do.
    """

    def run(batches):
        found: dict[int, list] = {0: [], 1: []}
        ends = 0
        for batch in batches:
            every = [normal(t) for t in texts(batch.column("text"))]
            ends += len(every)
            for _, lead, parts in parts_of(every, 2):
                for kind, keys in ((0, grams(lead, parts, 2)[0]), (1, word_hashes(parts)[0])):
                    found[kind].append(_counted(np.sort(keys)))
                    if len(found[kind]) > 16:
                        found[kind] = [_merge(found[kind])]
        merged = [_merge(found[k]) for k in (0, 1)]
        kinds = np.concatenate([np.full(len(k), i) for i, (k, _) in enumerate(merged)] + [[2]])
        keys = np.concatenate([*(k.view(np.int64) for k, _ in merged), [0]])
        counts = np.concatenate([*(c for _, c in merged), [ends]])
        for a in range(0, len(keys), 1 << 16):
            some = [pa.array(v[a : a + (1 << 16)], t) for v, t in ((kinds, pa.int32()), (keys, pa.int64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(some, names=["kind", "key", "n"])

    counted = docs.where(learned).select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    triple = F.when(F.col("kind") == 0, F.col("key"))
    rows = counted.groupBy("kind", triple.alias("triple")).agg(F.sum("n").alias("n"), F.count("*").alias("keys")).toArrow().to_pydict()
    kind, triple, n, keys = (np.array([v or 0 for v in rows[c]], dtype=np.int64) for c in ("kind", "triple", "n", "keys"))
    order = np.flatnonzero(kind == 0)[np.argsort(triple[kind == 0])]
    ends = int(n[kind == 2].sum())
    return (triple[order].astype(np.uint64), n[order]), int(n[kind == 1].sum()) + ends, int(keys[kind == 1].sum()) + (ends > 0)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
ASKED = "kind int, bucket int, grp long, shard long, keys binary, counts binary"
REPLIED = "shard long, kind int, keys binary, reply binary"
SUMMED = "kind int, bucket int, grp long, keys binary, counts binary"


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32(doc_id as text) mod `modulus` is `held` are not learned from. base_score is that of
    add-one word unigrams over words and an end token; score is the trie's, of `order` 3 or more. A null text is
    empty, a null id counts as empty text. Repeated rows are learned and scored as often as they come; without
    learned rows every byte costs log10(256). Other columns are not read; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    kind_of_id = dict(docs.dtypes)["doc_id"]
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    buckets, groups = min(BUCKETS, max(8, n_shards)), -(-n_shards // GROUP)
    triples, n_train, n_distinct = statistics(docs, crc != held)
    end_count = int(triples[1][(triples[0] & np.uint64(255)) == END].sum())
    shared = docs.sparkSession.sparkContext.broadcast(triples)  # 2^24 counts at most
    # Rows go by id and text, so rows without an id spread; equal rows may meet, in any shard alike.
    sharded = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)))

    def opened(table):
        ids = table.column("doc_id").to_pylist()
        return [normal(t) for t in texts(table.column("text"))], np.array([split_bucket(i, modulus) != held for i in ids], dtype=bool)

    def ask(key, table):
        every, learn = opened(table)
        shard = key[0].as_py()
        out = {"kind": [], "bucket": [], "grp": [], "shard": [], "keys": [], "counts": []}
        for kind, (keys, counts) in inventory(every, learn, order).items():
            home = _bucket(kind, keys, buckets)
            by = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = by[cuts[b] : cuts[b + 1]]
                for name, value in zip(out, (kind, b, shard // GROUP, shard, pack_sorted(keys[part]), pack(counts[part].astype(np.uint32))), strict=True):
                    out[name].append(value)
        return table_of(out, ASKED)

    def add_up(kind, bucket, group, table, width):
        keys, counts = _merge([(unpack_sorted(k), unpack(c, width).astype(np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        known = counts > 0
        return table_of({"kind": [kind], "bucket": [bucket], "grp": [group], "keys": [pack_sorted(keys[known])], "counts": [pack(counts[known])]}, SUMMED)

    def sum_group(key, table):
        return add_up(*(k.as_py() for k in key), table, np.uint32)

    def sum_bucket(key, table):
        return add_up(key[0].as_py(), key[1].as_py(), 0, table, np.int64)

    def answer(key, table, model):
        kind, bucket = key[0].as_py(), key[1].as_py()
        blobs = table.column("keys").to_pylist()
        if not blobs:  # no shard of this group asks
            return table_of({c: [] for c in ("shard", "kind", "keys", "reply")}, REPLIED)
        lists = [unpack_sorted(k) for k in blobs]
        keys = np.unique(np.concatenate(lists))
        learned, counts = unpack_sorted(model.column("keys")[0].as_py()), unpack(model.column("counts")[0].as_py(), np.int64)
        if kind == 0:
            value = code_lengths(keys, learned, counts, shared.value, order).astype(np.float32)
        else:
            value, asked_too = np.zeros(len(keys), dtype=np.int64), np.isin(learned, keys)
            value[np.searchsorted(keys, learned[asked_too])] = counts[asked_too]
        replies = [pack(value[np.searchsorted(keys, k)]) for k in lists]
        return table_of({"shard": table.column("shard"), "kind": [kind] * len(lists), "keys": blobs, "reply": replies}, REPLIED)

    def finish(key, table, replies):
        every, learn = opened(table)
        told = {}
        for kind, number in ((0, np.float32), (1, np.int64)):
            mine = [(unpack_sorted(k), unpack(r, number)) for q, k, r in zip(*(replies.column(c).to_pylist() for c in ("kind", "keys", "reply")), strict=True) if q == kind]
            keys, values = (np.concatenate([m[i] for m in mine]) if mine else np.zeros(0, t) for i, t in ((0, np.uint64), (1, number)))
            by = np.argsort(keys)
            told[kind] = keys[by], values[by]
        n, known_n, base, total = (np.zeros(len(every)) for _ in range(4))
        unit = np.log10(n_train + n_distinct + 1) if n_train else 0.0
        for owner, lead, parts in parts_of(every, order):
            keys, first = grams(lead, parts, order)
            by = np.argsort(keys)
            u, c = _counted(keys[by])
            each = np.empty(len(keys))
            each[by] = np.repeat(told[0][1][np.searchsorted(told[0][0], u)], c)
            np.add.at(total, owner, np.add.reduceat(each, first))
            h, words = word_hashes(parts)
            c = told[1][1][np.searchsorted(told[1][0], h)] if len(h) else np.zeros(0)
            past = np.cumsum(words)
            for target, part in ((base, np.log10(c + 1) - unit), (known_n, c > 0)):
                sums = np.concatenate([[0.0], np.cumsum(part)])
                np.add.at(target, owner, sums[past] - sums[past - words])
            np.add.at(n, owner, words)
        base += np.log10(end_count + 1) - unit
        known_n += end_count > 0
        return table_of(
            {"doc_id": table.column("doc_id"), "held_out": ~learn, "n_tokens": (n + 1).astype(np.int64), "n_known": known_n.astype(np.int64), "train_tokens": [n_train] * len(every), "base_score": base, "score": total},
            schema,
        )

    schema = f"doc_id {kind_of_id}, held_out boolean, {SCORES}"
    asked = sharded.groupBy("shard").applyInArrow(ask, ASKED)
    summed = asked.groupBy("kind", "bucket", "grp").applyInArrow(sum_group, SUMMED)
    models = summed.groupBy("kind", "bucket").applyInArrow(sum_bucket, SUMMED)
    for_groups = models.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    answers = asked.groupBy("kind", "bucket", "grp").cogroup(for_groups.groupBy("kind", "bucket", "grp")).applyInArrow(answer, REPLIED)
    return sharded.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finish, schema)
