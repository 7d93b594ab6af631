"""SimHash near-duplicates: fingerprints, pigeonring candidate filtering and linked components."""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts
from tessera.llm.components import components, saved

BITS = 64
SEED = 42


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of word shingles (ASCII lower case, repeats included); no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[min(width, len(words)) - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one row per input row."""

    def run(batch):
        fp = np.array([fingerprint(t, width) for t in texts(batch.column("text"))], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}

    kind = dict(docs.dtypes)[doc_id]
    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp long")


def segments(count: int) -> list[int]:
    """Masks of `count` consecutive segments that split the 64 bits, as signed longs."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [int(np.uint64((1 << b) - (1 << a)).view(np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_filter(x: str, masks: list[int], distance: int) -> str:
    """SQL that holds if some chain of consecutive segments of the ring stays within its budget at every length.

    If all segments differ in at most `distance` bits together, then from some start the first l segments
    differ in at most l * distance / count bits, for every l; so no link is lost.
    """
    count = len(masks)
    diff = [f"bit_count({x} & {m}L)" if m != -(1 << 63) else f"bit_count({x} & (-9223372036854775807L - 1L))" for m in masks]
    chains = []
    for start in range(count):
        terms = []
        for length in range(1, count):
            total = " + ".join(diff[(start + k) % count] for k in range(length))
            terms.append(f"{total} <= {length * distance // count}")
        chains.append("(" + " and ".join(terms) + ")")
    return "(" + " or ".join(chains) + ")"


def plan_segments(n: int, distance: int) -> int:
    """Segments so that chance meetings in a bucket stay rarer than the fingerprints themselves; any choice finds every link."""
    for count in range(distance + 2, 2 * distance + 1):
        if n * comb(count, distance) / 2 ** (BITS * (count - distance) / count) < 8:
            return count
    return 2 * distance


def links(nodes: DataFrame, n: int, distance: int = 4, crowd: int = 48) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column fp) to connect exactly those within `distance` bits.

    Two fingerprints that differ in at most d of m segments agree in some m - d, so each is filed under every
    choice of m - d segments. A bucket of up to `crowd` members is searched pair by pair behind the pigeonring
    filter. Members of fuller buckets instead file the ball of half the distance around themselves: two of them
    meet in a point exactly if they are within the distance, so every point links its members to the smallest,
    which grows with the members and not with their pairs.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    count = plan_segments(n, distance)
    masks = segments(count)
    unions = []
    for kept in combinations(masks, count - distance):
        m = 0
        for k in kept:
            m |= k
        unions.append(m)
    filed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in unions])).alias("choice", "part"))
    sizes = filed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = filed.join(sizes.hint("merge"), ["choice", "part"])  # hints: nothing here has a size bound, so nothing may be broadcast
    groups = met.where(F.col("n") <= crowd).groupBy("choice", "part").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    ring = ring_filter("(a ^ b)", masks, distance)
    pairs = groups.select(F.expr(f"explode(flatten(transform(g, (a, i) -> transform(filter(slice(g, i + 2, {crowd}), b -> {ring} and bit_count(a ^ b) <= {distance}), b -> named_struct('a', a, 'b', b)))))").alias("p")).select("p.a", "p.b")
    hot = met.where(F.col("n") > crowd).select("fp").distinct()
    one = "shiftleft(1L, i)"
    ball = {2: f"concat(array(fp), transform(sequence(0, 63), i -> fp ^ {one}))", 4: f"concat(array(fp), flatten(transform(sequence(0, 63), i -> transform(sequence(i + 1, 64), j -> fp ^ {one} ^ if(j = 64, 0L, shiftleft(1L, j))))))"}
    if distance not in ball:
        return pairs.distinct()
    points = hot.select("fp", F.explode(F.expr(ball[distance])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z").select("point", "a")
    stars = points.join(least.hint("merge"), "point").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest id linked, directly or not.

    Rows of equal fingerprints are one node, so copies are never paired. Null and blank texts share
    fingerprint 0 and are linked like any others. A null id takes its component from the others; a component
    of null ids alone has a null component. Repeated rows are returned as often as they come.
    """
    rows = saved(fingerprints(docs, doc_id, text, width))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), nodes.count(), distance)).withColumnRenamed("node", "fp")
    rooted = saved(nodes.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Both sides of this join are plain exchanges, so that a root with very many nodes can be split.
    smallest = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = rooted.select("fp", "root").join(smallest.hint("merge"), "root").select("fp", "component_id")
    return rows.join(by_node.hint("merge"), "fp").select("doc_id", "fp", "component_id")
