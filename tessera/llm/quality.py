"""Quality rules kept as a ledger: every rule is evaluated once, its failures stored as bits beside
the measurements; policies are masks over those bits, so a new policy or an ablation never reads text again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long"

#: Bit order is part of the stored ledger: append new rules, never renumber. A rule is SQL over the measurements, true on failure.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_words", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "10 * n_upper_words > 4 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("web-1", tuple(BIT)), Policy("web-lenient-1", ("few_words", "repeated_windows", "symbol_words")))}

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words lying in a window of `width` words that occurs at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), dtype=np.uint64, count=len(words))
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed += (ids[k : k + n] + np.uint64(1)) * _MULTIPLIERS[k % 5]
    order = np.sort(mixed)
    same = order[1:][order[1:] == order[:-1]]
    if not same.size:
        return 0
    at = np.flatnonzero(np.isin(mixed, same))  # the hash only nominates; the ids below decide
    groups: dict[bytes, list[int]] = {}
    for i in at.tolist():
        groups.setdefault(ids[i : i + width].tobytes(), []).append(i)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for starts in groups.values():
        if len(starts) > 1:
            np.add.at(cover, np.array(starts), 1)
            np.add.at(cover, np.array(starts) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    if not words:
        return (0, 0, sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), 0, 0, 0, 0)
    joined = b" ".join(words).decode("utf-8", "replace")
    seen: set[bytes] = set()
    lines = repeats = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeats += line in seen
            seen.add(line)
    return (
        len(words),
        len(joined) - len(words) + 1,
        sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        lines,
        repeats,
        repeated_words(words),
        sum(map(str.isupper, joined.split(" "))),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): one row per input row, bit i of `failed` set if rule i failed.

    A null or blank text has no words and so fails `few_words`; repeated rows give repeated results; other
    columns of the input are not read. An empty table gives an empty ledger.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batch):
        rows = [measure(t) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows), strict=True))

    kind = dict(docs.dtypes)[doc_id]
    measured = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, {MEASURES}")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def sole_rule(policy: Policy):
    """The rule that alone makes the policy reject a row: without it the row would be kept. Null where none or several do."""
    left = F.col("failed").bitwiseAND(F.lit(policy.mask))
    return F.coalesce(*[F.when(left == BIT[r], F.lit(r)) for r in policy.rules])


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only): documents a rule fails, and those it alone rejects, from one pass over the masks."""
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    each = masks.select("mask", "n", rules).select("mask", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
