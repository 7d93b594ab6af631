"""Toxicity by a subsequence string kernel: words are compared with landmark strings by the gap-weighted kernel,
mapped through a Nyström factor, and judged by a linear support vector machine. Labels belong to documents, so
the machine is trained on witness words of their sentences; a document scores as its most toxic word."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts

ORDER = 3
DECAY = 0.6
LONGEST = 24  # longer words are compared piece by piece, by overlapping pieces of this many letters


def letters(word: str) -> str:
    """Lower-cased letters and digits of a word: characters put between them do not count."""
    return word.lower() if word.isalnum() else "".join(filter(str.isalnum, word.lower()))


def pieces(word: str) -> list[str]:
    """The word, or the overlapping pieces of one longer than LONGEST; they leave out no letter."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def stretches(unit: str) -> list[str]:
    """What a unit is compared by: a word by itself; a spelled-out one by itself and its every stretch that is sure to
    lie whole in one piece, since letters around an insult would drown it in the kernel."""
    if " " not in unit:
        return [unit]
    w = unit.replace(" ", "")
    return list({w, *(w[i : i + n] for n in range(ORDER, min(len(w), LONGEST // 2 + 2)) for i in range(len(w) - n + 1))})


def units(text: str) -> dict[str, int]:
    """Units of a text with their counts: folded words, and whole runs of spelled-out single letters, which keep a
    space between the letters. Very long ones come by pieces."""
    out: dict[str, int] = {}
    raw = text.split()
    for w, n in Counter(raw).items():
        w = w.lower() if w.isalnum() else letters(w)
        if ORDER <= len(w) <= LONGEST:
            out[w] = out.get(w, 0) + n
        elif len(w) > LONGEST:
            for piece in pieces(w):
                out[piece] = out.get(piece, 0) + n
    run: list[str] = []
    last = -1

    def end():
        if len(run) >= ORDER:
            for piece in map(" ".join, pieces("".join(run))):
                out[piece] = out.get(piece, 0) + 1
        run.clear()

    for i in [i for i, w in enumerate(raw) if len(w) <= 2]:
        if len(w := letters(raw[i])) == 1:
            if i != last + 1:
                end()
            run.append(w)
            last = i
    end()
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    whole = "".join([w[:width].ljust(width, "\0") for w in strings])
    return np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).reshape(len(strings), width)


def kernel(words: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Normalised gap-weighted subsequence kernel, words by landmarks.

    Common subsequences of `order` letters count decay^(span in one + span in the other). The recursion runs over
    the letters of the words, for all words of one length and all landmarks at a time.
    """
    out = np.zeros((len(words), len(marks)), dtype=np.float32)
    by_word, by_mark = {}, {}
    for i, w in enumerate(words):
        by_word.setdefault(len(w), []).append(i)
    for i, m in enumerate(marks):
        by_mark.setdefault(-(-len(m) // 3) * 3, []).append(i)
    for width, mi in by_mark.items():
        tables = _tables([marks[i] for i in mi], width, decay)
        for length, wi in by_word.items():
            for at in range(0, len(wi), 128):
                part = wi[at : at + 128]
                out[np.ix_(part, mi)] = _raw(_codes([words[i] for i in part], length), tables, order, decay)
    return out / np.maximum(np.sqrt(np.outer(_selves(words, order, decay), _selves(marks, order, decay))), 1e-9)


def _tables(marks: list[str], width: int, decay: float):
    """By letter, where it stands in the landmarks: those places, and their decayed sums up to just before each place."""
    b = _codes(marks, width)
    alphabet = np.unique(b[b > 0])
    places = np.zeros((len(alphabet) + 1, len(marks), width), dtype=np.float32)
    for k, c in enumerate(alphabet):
        places[k] = (b == c) * decay**2
    gap = np.arange(width)[None, :] - np.arange(width)[:, None] - 1
    before = np.where(gap >= 0, decay ** np.maximum(gap, 0), 0).astype(np.float32)
    return alphabet, places, places @ before, before


def _raw(a: np.ndarray, tables, order: int, decay: float) -> np.ndarray:
    alphabet, places, sums, before = tables
    code = np.minimum(np.searchsorted(alphabet, a), len(alphabet) - 1)
    code = np.where(alphabet[code] == a, code, len(alphabet))
    shape = (len(a), *places.shape[1:])
    levels = [np.zeros(shape, dtype=np.float32) for _ in range(order - 1)]
    total = np.zeros(shape[:2], dtype=np.float32)
    for i in range(a.shape[1]):
        here = places[code[:, i]]
        total += np.einsum("nml,nml->nm", here, levels[-1])
        for k in range(order - 2, 0, -1):
            levels[k] *= np.float32(decay)
            levels[k] += (here * levels[k - 1]).reshape(-1, shape[2]).dot(before).reshape(shape)
        levels[0] *= np.float32(decay)
        levels[0] += sums[code[:, i]]
    return total


def _selves(strings: list[str], order: int, decay: float) -> np.ndarray:
    """Kernel of each string with itself, for all strings of one length at a time, some hundreds together."""
    out = np.zeros(len(strings), dtype=np.float32)
    groups = {}
    for i, s in enumerate(strings):
        groups.setdefault(len(s), []).append(i)
    for length, at in groups.items():
        if length < order:
            continue
        step = np.arange(length)[:, None] - np.arange(length)[None, :] - 1
        back = np.where(step >= 0, decay ** np.maximum(step, 0), 0).astype(np.float32).T
        along = lambda x, back=back, length=length: (x.reshape(-1, length) @ back).reshape(-1, length, length)
        for some in (at[i : i + 512] for i in range(0, len(at), 512)):
            x = _codes([strings[i] for i in some], length)
            same = (x[:, :, None] == x[:, None, :]) * np.float32(decay * decay)
            met = same
            for _ in range(order - 1):
                met = same * along(along(met).transpose(0, 2, 1))  # symmetric, so both sides are taken alike
            out[some] = met.sum(axis=(1, 2))
    return out


#: Entries up to which a weight for every three letters is kept as one table (4 bytes each).
DENSE = 1 << 22


class _Linear:
    """The sum of weighted, normalised kernels with all landmarks: the kernel is a sum over common subsequences, so
    the landmarks' weights are added up for every subsequence once, and a word only adds up those of its own."""

    def __init__(self, marks: list[str], weights: np.ndarray, order: int = ORDER, decay: float = DECAY):
        self.marks, self.weights, self.decay, self.table = marks, weights, decay, None
        alphabet = sorted(set("".join(marks)))
        n = len(alphabet) + 1  # the last stands for all other letters
        if order != 3 or n**3 > DENSE:
            return
        self.n, self.place = n, np.full(0x110000, n - 1, dtype=np.int32)
        self.place[[ord(c) for c in alphabet]] = np.arange(n - 1)
        table = np.zeros(n**3)
        for m, w in zip(marks, weights / np.maximum(np.sqrt(_selves(marks, order, decay)), 1e-9), strict=True):
            c = self.place[_codes([m], len(m))[0]].tolist()
            for i, j, k in combinations(range(len(m)), 3):
                table[(c[i] * n + c[j]) * n + c[k]] += w * decay ** (k - i + 1)
        self.table = table.astype(np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            return kernel(words, self.marks) @ self.weights
        out = np.zeros(len(words), dtype=np.float32)
        by_length = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            for some in (at[i : i + 4096] for i in range(0, len(at), 4096)):
                c = np.ascontiguousarray(self.place[_codes([words[i] for i in some], length)].T)
                total = np.zeros(len(some), dtype=np.float32)
                for i, j in combinations(range(length), 2):
                    two = (c[i] * self.n + c[j]) * self.n
                    for k in range(j + 1, length):
                        total += self.table.take(two + c[k]) * np.float32(self.decay ** (k - i + 1))
                out[some] = total
        return out / np.maximum(np.sqrt(_selves(words, ORDER, self.decay)), 1e-9)


class Model:
    """Landmarks with one weight each (the Nyström factor folded in), and a logistic judge of a document's margins."""

    def __init__(self, marks: list[str], weights: np.ndarray, bias: float, judge: np.ndarray | None = None):
        self.marks, self.weights, self.bias = marks, weights.astype(np.float32), bias
        self.judge = np.zeros(len(evidence([], [])) + 1) if judge is None else judge
        self._linear: _Linear | None = None  # made where words are judged

    def margins(self, words: list[str]) -> np.ndarray:
        if not self.marks or not words:
            return np.full(len(words), -1.0, dtype=np.float32)
        if self._linear is None:
            self._linear = _Linear(self.marks, self.weights)
        parts = {w: stretches(w) for w in words if " " in w}
        every = list(dict.fromkeys([*(w for w in words if w not in parts), *(s for p in parts.values() for s in p)]))
        known = dict(zip(every, (self._linear(every) + np.float32(self.bias)).tolist(), strict=True))
        return np.array([max(known[s] for s in parts[w]) if w in parts else known[w] for w in words], dtype=np.float32)

    def probability(self, margins: list[float], counts: list[int]) -> float:
        z = float(self.judge[:-1] @ evidence(margins, counts) + self.judge[-1])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def evidence(margins, counts) -> np.ndarray:
    """What a document shows: its most toxic unit, how often units pass the margin, and how dense they are."""
    m, c = np.asarray(margins, dtype=np.float64), np.asarray(counts, dtype=np.float64)
    n = c.sum()
    strong, sure = (c[m > 0].sum(), c[m > 0.7].sum()) if len(m) else (0.0, 0.0)
    top = float(np.clip(m.max(), -2, 2)) if len(m) else -2.0
    return np.array([top, math.log1p(strong), math.log1p(sure), math.log((strong + 0.3) / (n + 30)), math.log((sure + 0.3) / (n + 30))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept by damped Newton steps; features are standardised inside."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(y))]
    reg = np.full(z.shape[1], penalty)
    reg[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(reg), z.T @ (weight * (p - y)) + reg * w)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float64)
    z = np.c_[x.astype(np.float64), np.ones(len(y))]
    step = 1 / (2 * float(np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1]) + penalty)
    w = np.zeros(z.shape[1])
    v, t = w.copy(), 1.0
    reg = np.full(z.shape[1], penalty)
    reg[-1] = 0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v)) * y * weight * 2
        nxt = v - step * (reg * v - z.T @ slack)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = nxt + (t - 1) / nt * (nxt - w)
        w, t = nxt, nt
    return w[:-1], float(w[-1])


def _stems(word: str):
    """Strings that may stand for an inflected word: itself and its beginnings."""
    word = word.replace(" ", "")
    yield word
    for n in (4, 5, 6):
        if n < len(word):
            yield word[:n]


def _sure(toxic: int, clean: int, share: float, tried: int) -> bool:
    """Whether a stem seen in so many documents stands in toxic ones by more than the chance of one in 100 among all
    stems tried (Chernoff's bound)."""
    n = toxic + clean
    p = toxic / n
    apart = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if clean else 0.0)
    return p > share and n * apart > math.log(100 * tried)


def train(samples: list[tuple[dict[str, int], int]], n_marks: int = 32, rounds: int = 3, weights: dict[int, float] | None = None) -> Model:
    """Fits on (units with counts, label) pairs. Landmarks are the stems that best tell toxic documents from
    clean ones, each chosen for the toxic documents not covered three times yet, and frequent clean words. Stems
    beyond two thirds of `n_marks` are added as long as they cannot be toxic by chance (`_sure`), without a bound.

    The word machine learns from bounded witnesses of each sampled text: of a toxic one its three most toxic units
    that bear a landmark's stem, of a clean one four units spread over its vocabulary and, in every round, the two
    that look most toxic. The judge learns from all units of all sampled texts."""
    seen, kept = set(), []
    for u, y in samples:
        key = (frozenset(u), y)
        if u and key not in seen:
            seen.add(key)
            kept.append((u, y))
    nt, nc = sum(1 for _, y in kept if y), sum(1 for _, y in kept if not y)
    if not nt or not nc:
        return Model([], np.zeros(0), -1.0)
    stems_of = [({s for w in u for s in _stems(w)}, bool(y)) for u, y in kept]
    base = {True: Counter(), False: Counter()}
    for s, y in stems_of:
        base[y].update(s)
    odds = {}
    for s, c in base[True].items():
        if c >= 3:
            p, q = c / nt, (base[False][s] + 0.5) / (nc + 1)
            if p > 2 * q:
                odds[s] = math.log(p / q) * (1 + 0.02 * len(s))
    short = [[s & odds.keys(), 3] for s, y in stems_of if y]
    gain = Counter(x for s, _ in short for x in s)
    marks: list[str] = []
    few = n_marks * 2 // 3
    while gain:
        if len(marks) == few:
            gain = Counter({x: n for x, n in gain.items() if _sure(base[True][x], base[False][x], nt / (nt + nc), len(base[True]))})
            if not gain:
                break
        best = max(gain, key=lambda x: (gain[x] * odds[x], len(x), x))
        if gain[best] < 2:
            break
        marks.append(best)
        for entry in short:
            if entry[1] and best in entry[0]:
                entry[1] -= 1
                if not entry[1]:
                    gain.subtract(entry[0])
        for near in [x for x in gain if x.startswith(best) or best.startswith(x)]:
            del gain[near]
        gain = +gain
    if not marks:
        return Model([], np.zeros(0), -1.0)
    full = max(n_marks, len(marks) + n_marks - few)
    frequent = Counter(w for u, y in kept if not y for w in u if 4 <= len(w) <= LONGEST and " " not in w)
    for w, _ in sorted(frequent.items(), key=lambda p: (-p[1], p[0])):
        if len(marks) >= full:
            break
        if w not in marks:
            marks.append(w)
    gram = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    vocabulary = sorted({w for u, _ in kept for w in u})
    at = {w: i for i, w in enumerate(vocabulary)}
    raw = kernel([w.replace(" ", "") for w in vocabulary], marks)
    mapped = raw @ half.astype(np.float32)
    places = [np.array([at[w] for w in sorted(u)]) for u, _ in kept]
    labels = np.array([1 if y else -1 for _, y in kept])
    chosen = {m for m in marks if m in odds}
    first = np.array([max((odds[s] for s in _stems(w) if s in chosen), default=0.0) for w in vocabulary])
    scores = np.where(first > 0, first, -1.0) + 1e-3 * raw.max(axis=1)
    hard = {int(i) for p, y in zip(places, labels, strict=True) if y < 0 for i in p[:: max(1, len(p) // 4)]}
    w, b = np.zeros(len(marks)), -1.0
    for _ in range(rounds):
        positive = {int(i) for p, y in zip(places, labels, strict=True) if y > 0 for i in p[np.argsort(-scores[p])[:3]] if scores[i] > 0 and first[i] > 0}
        hard |= {int(i) for p, y in zip(places, labels, strict=True) if y < 0 for i in p[np.argsort(-scores[p])[:2]]}
        one, other = sorted(positive), sorted(hard - positive)
        if not one or not other:
            break
        w, b = _svm(mapped[one + other], np.concatenate([np.ones(len(one)), -np.ones(len(other))]))
        scores = mapped @ w + b
    final = raw @ (half @ w).astype(np.float32) + np.float32(b)
    spelled = [i for i, v in enumerate(vocabulary) if " " in v]
    final[spelled] = Model(marks, half @ w, b).margins([vocabulary[i] for i in spelled])
    shown = np.array([evidence(final[p], [u[k] for k in sorted(u)]) for p, (u, _) in zip(places, kept, strict=True)])
    weight = np.array([(weights or {}).get(1 if y > 0 else 0, 1.0) for y in labels])
    return Model(marks, half @ w, b, _logistic(shown, (labels > 0).astype(float), weight))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 800, n_marks: int = 32) -> Model:
    """Fits on at most `sample` labelled ids of each class, chosen by a hash of the id; whole texts are
    reduced to their distinct units on the executors. Rows without a label, id or unit are not learned from."""
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in judged.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model([], np.zeros(0), -1.0)
    first = [judged.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in sorted(counts)]
    chosen = first[0]
    for more in first[1:]:
        chosen = chosen.union(more)
    # The sample is a few thousand ids at most, so it travels to the texts and not the texts to it.
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def reduce(batch):
        found = [units(t.decode("utf-8", "replace")) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "units": [list(u) for u in found], "counts": [list(u.values()) for u in found]}

    rows = map_rows(some.select("doc_id", "toxic", "text"), reduce, f"doc_id {dict(some.dtypes)['doc_id']}, toxic int, units array<string>, counts array<int>").orderBy("doc_id", "units").collect()
    taken = Counter(r["toxic"] for r in rows)
    return train([(dict(zip(r["units"], r["counts"], strict=True)), r["toxic"]) for r in rows], n_marks, weights={k: counts[k] / max(n, 1) for k, n in taken.items()})


_REMEMBERED: dict = {}


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", remember: int = 500_000) -> DataFrame:
    """(doc_id, score) for every row, from its whole text; null and empty texts get the score of no evidence.

    Rows are judged alone: repeated rows agree, and other columns are not read. Margins of recent words are
    remembered by each worker, which changes the time only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_marks strings and weights
    key = (tuple(model.marks), model.weights.tobytes(), model.bias)

    def run(batches):
        m = shared.value
        if key not in _REMEMBERED:
            _REMEMBERED.clear()
            _REMEMBERED[key] = {}
        memo = _REMEMBERED[key]
        for batch in batches:
            ids, every = batch.column("doc_id"), texts(batch.column("text"))
            for at in range(0, len(every), 256):
                found = [units(t.decode("utf-8", "replace")) for t in every[at : at + 256]]
                new = list(set().union(*found).difference(memo))
                memo.update(zip(new, m.margins(new).tolist(), strict=True))
                out = [m.probability([memo[w] for w in u], list(u.values())) for u in found]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(out, pa.float64())], names=["doc_id", "score"])
                if len(memo) > remember:
                    memo.clear()

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
