"""Greedy longest-match word-piece lengths in linear time: a trie over pieces whose failure links carry the
number of pieces they pop, so a word is counted in one pass and no piece is ever built."""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts


class Automaton:
    """Counts greedy pieces of a word.

    `starts` are pieces that may open a word, `continuations` those that may follow. A word that greedy
    matching cannot finish counts as one unknown piece.
    """

    def __init__(self, starts, continuations):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        self.fail = [-1, -1]
        self.popped = [0, 0]
        final = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    nxt = self.step.get(key)
                    if nxt is None:
                        nxt = self.step[key] = len(final)
                        final.append(False)
                    node = nxt
                if piece:
                    final[node] = True
        self._link(final)

    def _link(self, final: list[bool]) -> None:
        step, n = self.step, len(final)
        fail, popped = [-1] * n, [0] * n
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for byte, node in children.get(parent, ()):
                if final[node]:
                    fail[node], popped[node] = 1, 1
                else:
                    back, count = fail[parent], popped[parent]
                    while back >= 0 and (back << 8 | byte) not in step:
                        count += popped[back]
                        back = fail[back]
                    if back >= 0:
                        fail[node], popped[node] = step[back << 8 | byte], count
                queue.append(node)
        self.fail, self.popped = fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if greedy matching fails."""
        step, fail, popped = self.step.get, self.fail, self.popped
        node = total = 0
        for byte in word:
            nxt = step(node << 8 | byte)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                nxt = step(node << 8 | byte)
            node = nxt
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


class _Memo(dict):
    """Counts of the words seen lately; forgetting them changes the time only."""

    def __init__(self, automaton: Automaton, prefix: bytes, limit: int = 300_000):
        super().__init__()
        self.automaton, self.prefix, self.limit, self.unknown = automaton, prefix, limit, set()

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.prefix + word)
        if n < 0:
            self.unknown.add(word)
            n = 1
        self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.unknown.clear()


def split_rank_file(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level rank file: those with a leading space open words, the others continue them."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


@lru_cache(maxsize=2)
def _rank_memo(path: str) -> _Memo:
    return _Memo(Automaton(*split_rank_file(path)), b" ")


@lru_cache(maxsize=2)
def _piece_memo(pieces: tuple[str, ...], marker: str) -> _Memo:
    starts = [p.encode() for p in pieces if not p.startswith(marker)]
    return _Memo(Automaton(starts, [p[len(marker) :].encode() for p in pieces if p.startswith(marker)]), b"")


def token_counts(docs: DataFrame, vocabulary: str | tuple[str, ...], marker: str = "##", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row.

    `vocabulary` is the path of a byte-level rank file, readable on every executor, or a tuple of word pieces
    of which `marker` opens the continuing ones. Words break at ASCII white space. A null or blank text has
    no words and no tokens; an unmatched word counts as one unknown token. Rows are independent, so repeated
    ids and other columns do not matter.
    """

    def run(batch):
        memo = _rank_memo(vocabulary) if isinstance(vocabulary, str) else _piece_memo(vocabulary, marker)
        words, tokens, unknown = [], [], []
        for t in texts(batch.column("text")):
            w = t.split()
            words.append(len(w))
            tokens.append(sum(map(memo.__getitem__, w)))
            unknown.append(sum(map(memo.unknown.__contains__, w)) if memo.unknown else 0)
            memo.trim()
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

    kind = dict(docs.dtypes)[doc_id]
    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
