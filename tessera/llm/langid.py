"""Language identification by hierarchical discrimination: linear machines first choose the language family,
then one-versus-one linear support vector machines separate the languages inside it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, pack, texts, unpack

#: Language codes by family. A code listed nowhere is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
ORDERS = (1, 2, 3)
BUCKETS = 1 << 13
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def features(text: bytes) -> np.ndarray:
    """Unit vector of damped counts of hashed byte n-grams of the lower-cased whole text."""
    raw = b" " + text.decode("utf-8", "replace").lower().encode() + b" "
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(ORDERS) * BUCKETS, dtype=np.float32)
    gram = np.zeros(len(x), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        n = len(x) - order + 1
        if n <= 0:
            break
        gram = (gram[:n] << np.uint32(8)) | x[order - 1 :]
        hashed = (gram * _MIX) >> np.uint32(19)
        part = np.log1p(np.bincount(hashed, minlength=BUCKETS)).astype(np.float32)
        out[k * BUCKETS : (k + 1) * BUCKETS] = part / max(float(np.sqrt(part @ part)), 1e-9)
    return out


def _svm(gram: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine in the span of the sample: coefficients and bias, both classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    a, bias = np.zeros(len(y)), 0.0
    step = 1.0 / (2 * max(float(np.linalg.eigvalsh(gram * np.sqrt(np.outer(weight, weight)))[-1]), 1e-6) + 2 + penalty)
    za, zb, t = a.copy(), bias, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (gram @ za + zb)) * y * weight * 2
        na, nb = za - step * (penalty * za - slack), zb + step * slack.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        za, zb = na + (t - 1) / nt * (na - a), nb + (t - 1) / nt * (nb - bias)
        a, bias, t = na, nb, nt
    return a, bias


class Hierarchy:
    """Pairwise machines at the family level and inside every family, stacked in one weight matrix."""

    def __init__(self, langs: list[str], x: np.ndarray, y: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        labels, groups = np.array(y, dtype=object), np.array([family_of(v) for v in y], dtype=object)
        gram = (x @ x.T).astype(np.float64) if len(y) else np.zeros((0, 0))
        pairs = [("family", groups, *p) for p in combinations(self.families, 2)]
        pairs += [(f, labels, *p) for f in self.families for p in combinations(self.members[f], 2)]
        self.pairs, rows, self.bias = [(p[0], p[2], p[3]) for p in pairs], [], []
        for _, tags, one, other in pairs:
            at = np.flatnonzero((tags == one) | (tags == other))
            a, b = _svm(gram[np.ix_(at, at)], np.where(tags[at] == one, 1.0, -1.0))
            rows.append(x[at].T @ a.astype(np.float32))
            self.bias.append(b)
        self.weights = np.array(rows, dtype=np.float32) if rows else np.zeros((0, len(ORDERS) * BUCKETS), np.float32)

    def _level(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Winner by votes, then by summed margins; how sure the closest contest was."""
        if len(names) == 1:
            return names[0], 1.0
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 99.0)
        for (at, one, other), m in zip(self.pairs, margins, strict=True):
            if at == level:
                votes[one if m > 0 else other] += 1
                sums[one] += m
                sums[other] -= m
                least[one], least[other] = min(least[one], m), min(least[other], -m)
        best = max(names, key=lambda v: (votes[v], sums[v]))
        return best, float(1 / (1 + np.exp(-4 * np.clip(least[best], -20, 20))))

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not LETTER.search(text.decode("utf-8", "replace")):
            return UNDETERMINED, 0.0
        margins = self.weights @ features(text) + np.array(self.bias, dtype=np.float32) if self.pairs else np.zeros(0)
        family, sure = self._level("family", self.families, margins)
        lang, inside = self._level(family, self.members[family], margins)
        return lang, sure * inside


def fit(docs: DataFrame, sample_per_language: int = 300, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Hierarchy:
    """Fits on at most `sample_per_language` rows of each language, chosen by a hash of the id.

    Only sparse feature vectors of that bounded sample reach the driver. Rows without a language or a letter
    are not learned from.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Hierarchy([], np.zeros((0, len(ORDERS) * BUCKETS), np.float32), [])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * sample_per_language / n + 20 / n))) for k, n in sorted(counts.items())])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = rows.withColumn("h", h).where(F.col("h") < share * (1 << 30))

    def sparse(batch):
        out = []
        for t in texts(batch.column("text")):
            if not LETTER.search(t.decode("utf-8", "replace")):
                out.append(None)
                continue
            v = features(t)
            at = np.flatnonzero(v)
            out.append(pack(np.concatenate([at.astype(np.float32), v[at]])))
        return {"lang": batch.column("lang"), "h": batch.column("h"), "v": pa.array(out, pa.binary())}

    vectors = map_rows(near.select("text", "lang", "h"), sparse, "lang string, h long, v binary").where("v is not null")
    order = Window.partitionBy("lang").orderBy("h", "v")
    chosen = vectors.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_per_language).orderBy("lang", "k").collect()
    x = np.zeros((len(chosen), len(ORDERS) * BUCKETS), dtype=np.float32)
    for i, r in enumerate(chosen):
        at, v = unpack(r["v"], np.float32).reshape(2, -1)
        x[i, at.astype(np.int64)] = v
    return Hierarchy(sorted({r["lang"] for r in chosen}), x, [r["lang"] for r in chosen])


def identify(docs: DataFrame, model: Hierarchy, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; `und` with score 0 where the text is null or has no letter.

    Each row is judged alone from its whole text, so repeated rows agree and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three pair machines of fixed width: a few hundred KB

    def run(batch):
        got = [shared.value.predict(t) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    kind = dict(docs.dtypes)[doc_id]
    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a language the model can name; the others are `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.predict(t)[0] != UNDETERMINED for t in texts(batch.column(text))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
