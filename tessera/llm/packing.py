"""Sequence packing by shortest-pack-first over the histogram of piece lengths: patterns are planned from the
bounded histogram on the driver, then joined back to the pieces by their rank within a length."""

from __future__ import annotations

import zlib
from bisect import insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts

MAX_TOKENS = 2048
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encodes a text to ids. A byte-level tokenizer file is read as ranks for tiktoken, which gives the same
    ids several times faster; any other kind of file is run as it is."""
    import json

    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        spec = json.load(f)
    fast = _ranks(spec)
    if fast is None:
        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


#: Fixed value: the split pattern of byte-level files that name none.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level files write bytes as printable characters: printable ones as themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict):
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
        return None
    byte_of = _byte_of()
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    singles = [k for k in vocab if len(k) == 1]
    order = {p: i for i, p in enumerate([*sorted(singles, key=vocab.get), *merged])}
    if len(order) != len(vocab) or any(order.get(k) != v for k, v in vocab.items()):
        return None  # ids that do not follow the merges cannot be ranks
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)


def pieces_of(ids: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document: full ones, then the rest."""
    raw = ids.tobytes()
    return [(at, min(limit, len(ids) - at), zlib.crc32(raw[4 * at : 4 * (at + limit)])) for at in range(0, len(ids), limit)]


def cut(docs: DataFrame, tokenizer: str, limit: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), a row per piece. `tokenizer` is a file path readable on every executor."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batch):
        encode = _encoder(tokenizer)
        at, out, totals = [], [], []
        for i, t in enumerate(texts(batch.column("text"))):
            ids = np.append(encode(t.decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
            p = pieces_of(ids, limit)
            out += p
            at += [i] * len(p)
            totals += [len(ids)] * len(p)
        starts, lengths, crcs = zip(*out, strict=True)
        return {"doc_id": batch.column("doc_id").take(pa.array(at)), "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals}

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, {PIECES}")


def plan(histogram: dict[int, int], limit: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, longest first; how many such sequences) by shortest-pack-first.

    Lengths are placed longest first, each into the emptiest open patterns that can take it; what finds no room
    opens new ones. Work grows with distinct lengths and patterns, not with the pieces they stand for.
    """
    open_at: dict[int, dict[tuple[int, ...], int]] = {}  # room -> pattern -> count
    rooms: list[int] = []
    full: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if not room:
            full[pattern] = full.get(pattern, 0) + count
            return
        if room not in open_at:
            open_at[room] = {}
            insort(rooms, room)
        open_at[room][pattern] = open_at[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = 1 if limit // length == 1 else min(left, limit // length)
                count = left // each
                put((length,) * each, limit - each * length, count)
                left -= each * count
                continue
            room = rooms[-1]
            pattern, count = open_at[room].popitem()
            if not open_at[room]:
                del open_at[room]
                rooms.pop()
            fit = min(room // length, max(1, left // count))
            used = min(count, left // fit) if fit > 1 else min(count, left)
            put(pattern + (length,) * fit, room - fit * length, used)
            if used < count:
                put(pattern, room, count - used)
            left -= fit * used
    return [*full.items(), *((p, n) for group in open_at.values() for p, n in group.items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ascending first ranks of its runs, and the first sequence and the offset of each run."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            out.setdefault(n, []).append((rank, base, offset))
            taken[n] = rank + count
            offset += n
        base += count
    return {n: tuple(np.array(v, dtype=np.int64) for v in zip(*runs, strict=True)) for n, runs in out.items()}


#: Pieces of one length that are ranked in one group at most, and the groups that a length has at most for being shorter than that.
RANKED = 50_000
SPREAD = 256


def pack(docs: DataFrame, tokenizer: str, limit: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text", ranked: int = RANKED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Each document is its ids and an end id, cut at every `limit` tokens; a null text is empty and still has its
    end id. Pieces are ranked within their length by a hash group and then by id; a length has a group for every
    `ranked` pieces, or up to SPREAD smaller ones, so no length, however common, is ranked in one task, and neither
    are null or repeated ids. Repeated rows are documents of their own. Only the histogram (by length and group: a
    number for every `ranked` pieces, and SPREAD a length at most) and the patterns, bounded by `limit`, reach the
    driver. An empty table gives none.
    """
    from tessera.llm.components import saved

    pieces = saved(cut(docs, tokenizer, limit, doc_id, text))
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow().to_pydict()
    groups = np.ones(limit + 1, dtype=np.int64)
    n = np.array(lengths["n"], dtype=np.int64)
    groups[lengths["length"]] = np.maximum(-(-n // ranked), np.minimum(-(-n // 64), SPREAD))
    # The pieces are read back from where they were written, so their numbers are the same every time.
    number = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())
    grouped = pieces.withColumn("grp", F.pmod(number, F.get(F.lit(groups.tolist()), F.col("length").cast("int"))).cast("int"))
    counts = grouped.groupBy("length", "grp").agg(F.count("*").alias("n")).toArrow().to_pydict()
    first = np.cumsum(groups) - groups
    table = np.zeros(groups.sum(), dtype=np.int64)
    table[first[counts["length"]] + np.array(counts["grp"], dtype=np.int64)] = counts["n"]
    past = np.concatenate([[0], np.cumsum(table)])
    before = past[:-1] - np.repeat(past[first], groups)
    totals = np.add.reduceat(table, first)
    layout = slots(plan({int(n): int(totals[n]) for n in np.flatnonzero(totals)}, limit))
    shared = docs.sparkSession.sparkContext.broadcast((first, before, layout))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "start", "ids_crc32")
    placed = grouped.withColumn("rank", F.row_number().over(order))

    def place(batch):
        firsts, offsets, runs = shared.value
        length, grp, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "grp", "rank"))
        rank = offsets[firsts[length] + grp] + rank - 1
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            start, base, shift = runs[n]
            k = np.searchsorted(start, rank[at], side="right") - 1
            sequence[at], offset[at] = base[k] + rank[at] - start[k], shift[k]
        return {c: batch.column(c) for c in names} | {"sequence_id": sequence, "offset": offset}

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = dict(pieces.dtypes)["doc_id"]
    return map_rows(placed, place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
