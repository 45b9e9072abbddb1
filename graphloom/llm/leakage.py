"""Evaluation passages inside training texts, found by a random-walk embedding of edit distance and bit-sampling buckets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalikes import alike_groups

#: A leaked passage: this many successive words, with at most this many of them changed, dropped or added.
WINDOW, EDITS = 12, 3
#: Random walks, buckets sampled from each, and positions of an embedded window that make up a bucket.
WALKS, SAMPLES, POSITIONS = 16, 3, 5
#: Steps of a walk; each window is embedded in as many symbols.
STEPS = 3 * WINDOW
#: About how many passages are indexed, and sent to the executors, at once (some 40 kB each). More are searched in blocks.
BLOCK = 1000
SEED = 20240607

_WORD = re.compile(r"[a-z0-9]+")
#: Words of any script: runs of letters, digits and vowel signs; where a script has no blanks, each character is a word.
_ANY_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿฀-๿]|(?:(?![぀-ヿ㐀-䶿一-鿿฀-๿])(?:[^\W_]|[ऀ-ॣ०-ൿ]))+")
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_ALIKE = {ord(ch): group[0].lower() for group in alike_groups() for ch in group[1:]}
_SOME_ALIKE = re.compile("[" + "".join(map(chr, _ALIKE)) + "]")


def words(text: str) -> list[str]:
    """Words of every script in lower case, without accents, unseen characters and look-alikes."""
    if text.isascii():
        return _WORD.findall(text.lower())
    text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    if _SOME_ALIKE.search(text):
        text = text.translate(_ALIKE)
    return _ANY_WORD.findall(text.lower())


class PassageIndex:
    """Buckets of all windows of a block of passages."""

    def __init__(self, cases: list[tuple[str, str]]) -> None:
        self.names = [name for name, _ in cases]
        said = [words(text or "") for _, text in cases]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in said for w in t}))}
        ids = [np.array([self.vocabulary[w] for w in t], dtype=np.int32) for t in said]
        views = [np.lib.stride_tricks.sliding_window_view(t, WINDOW) for t in ids if len(t) >= WINDOW]
        owners = [np.full(len(t) - WINDOW + 1, i, dtype=np.int32) for i, t in enumerate(ids) if len(t) >= WINDOW]
        self.windows = np.concatenate(views) if views else np.zeros((0, WINDOW), np.int32)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        draw = np.random.default_rng(SEED)
        # The last two symbols are a foreign word and the end.
        self.symbols = len(self.vocabulary) + 2
        self.steps = draw.integers(0, 2, (WALKS, STEPS, self.symbols), dtype=np.int8)
        self.positions = [[np.sort(draw.choice(STEPS * 2 // 3, POSITIONS, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.buckets = []
        for key in self._keys(self.windows):
            order = np.argsort(key, kind="stable")
            self.buckets.append((key[order], order))

    def _embed(self, windows: np.ndarray, walk: int) -> np.ndarray:
        """Each window as the symbols that a random walk over it reads: few edits change few of them."""
        n = len(windows)
        padded = np.concatenate([windows, np.full((n, 1), self.symbols - 1, windows.dtype)], axis=1)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        last = max(p[-1] for p in self.positions[walk]) + 1
        out = np.empty((n, last), np.int64)
        for j in range(last):
            symbol = padded[rows, at]
            out[:, j] = symbol
            at = np.minimum(at + self.steps[walk, j, symbol], WINDOW)
        return out

    def _keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        for walk in range(WALKS):
            embedded = self._embed(windows, walk)
            for positions in self.positions[walk]:
                key = np.zeros(len(windows), np.int64)
                for p in positions:
                    key = key * self.symbols + embedded[:, p]
                yield key

    def ids(self, text: str) -> np.ndarray:
        get, other = self.vocabulary.get, self.symbols - 2
        return np.array([get(w, other) for w in words(text)], dtype=np.int32)

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Pairs (row of windows, passage window) that share a bucket and at least WINDOW - EDITS words."""
        found = []
        for (keys, order), key in zip(self.buckets, self._keys(windows)):
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            count = high - low
            rows = np.repeat(np.arange(len(windows)), count)
            if len(rows):
                within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                found.append(rows.astype(np.int64) * len(self.windows) + order[np.repeat(low, count) + within])
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        pairs = np.stack([pairs // len(self.windows), pairs % len(self.windows)], axis=1)
        kept = []
        for part in np.array_split(pairs, len(pairs) // 200_000 + 1):
            a, b = windows[part[:, 0]], self.windows[part[:, 1]]
            shared = np.zeros(len(part), np.int32)
            for j in range(WINDOW):
                shared += (a == b[:, j : j + 1]).any(axis=1)
            kept.append(part[shared >= WINDOW - EDITS])
        return np.concatenate(kept)

    def edits(self, passages: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the least edits that turn passages into a part of texts, and where that part ends."""
        n, m = texts.shape
        row = np.zeros((m + 1, n), np.int16)
        for i in range(WINDOW):
            now = np.empty_like(row)
            now[0] = i + 1
            for j in range(m):
                now[j + 1] = np.minimum(np.minimum(row[j + 1], now[j]) + 1, row[j] + (texts[:, j] != passages[:, i]))
            row = now
        return row.min(axis=0), row.argmin(axis=0)

    def hits(self, texts: list[str]) -> dict[int, list[tuple[str, int, int, int]]]:
        """Row of texts -> (case, from, to, edits) of every place in it that holds a part of a passage."""
        if not len(self.windows):
            return {}
        owners, starts, windows, segments = [], [], [], []
        lead, size = EDITS, WINDOW + 3 * EDITS
        for i, text in enumerate(texts):
            ids = self.ids(text)
            known = (ids < self.symbols - 2).astype(np.int32)
            if known.sum() < WINDOW - EDITS:
                continue
            # A place that holds a passage has so many known words among the next WINDOW ones.
            ahead = np.cumsum(np.concatenate([[0], known, np.zeros(WINDOW, np.int32)]))
            at = np.flatnonzero(ahead[WINDOW:][: len(ids)] - ahead[: len(ids)] >= WINDOW - EDITS)
            if len(at):
                padded = np.concatenate([np.full(lead, self.symbols - 2, np.int32), ids, np.full(size, self.symbols - 1, np.int32)])
                view = np.lib.stride_tricks.sliding_window_view(padded, size)[at]
                owners.append(np.full(len(at), i))
                starts.append(at)
                segments.append(view)
        if not owners:
            return {}
        owner, start, segment = np.concatenate(owners), np.concatenate(starts), np.concatenate(segments)
        windows, same = np.unique(segment[:, lead : lead + WINDOW], axis=0, return_inverse=True)
        pairs = self.candidates(windows)
        order = np.argsort(same.ravel(), kind="stable")
        low, high = np.searchsorted(same.ravel()[order], pairs[:, 0]), np.searchsorted(same.ravel()[order], pairs[:, 0], side="right")
        count = high - low
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows, passages = order[np.repeat(low, count) + within], np.repeat(pairs[:, 1], count)
        hits: dict[int, list[tuple[str, int, int, int]]] = {}
        for part in range(0, len(rows), 100_000):
            r, p = rows[part : part + 100_000], passages[part : part + 100_000]
            cost, end = self.edits(self.windows[p], segment[r])
            for k in np.flatnonzero(cost <= EDITS):
                stop = int(start[r[k]]) - lead + int(end[k])
                hits.setdefault(int(owner[r[k]]), []).append((self.names[self.owner[p[k]]], max(0, stop - WINDOW), stop, int(cost[k])))
        return hits


def accounted(hits: list[tuple[str, int, int, int]]) -> list[str]:
    """The cases of hits (case, from, to, edits) without those whose every hit lies where a closer case has its hits.

    Passages share phrases. Where one case's words stand, another's may differ from them by few enough words too; it
    then only counts if some hit of it is at least by half not covered by hits of fewer edits of accepted cases. Cases that
    fit a place equally well all count.
    """
    by_case: dict[str, dict[tuple[int, int], int]] = {}
    for case, a, b, cost in hits:
        own = by_case.setdefault(case, {})
        own[a, b] = min(cost, own.get((a, b), EDITS + 1))
    weight: dict[str, int] = {}
    for case, own in by_case.items():
        spared: dict[int, int] = {}
        for (a, b), cost in own.items():
            for k in range(a, b):
                spared[k] = max(EDITS + 1 - cost, spared.get(k, 0))
        weight[case] = sum(spared.values())
    order = sorted(by_case, key=lambda c: (-weight[c], c))
    best: dict[int, int] = {}
    accepted = []
    for case in order:
        own = by_case[case]
        new = any(sum(best.get(k, EDITS + 1) < cost for k in range(a, b)) * 2 <= b - a for (a, b), cost in own.items())
        if new:
            accepted.append(case)
            for (a, b), cost in own.items():
                for k in range(a, b):
                    best[k] = min(cost, best.get(k, EDITS + 1))
    return accepted


def leaked(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Columns doc_id, case_id: documents (doc_id, text) that hold a passage of cases (id, reference_passage).

    Held is a part of WINDOW successive words of the passage with up to EDITS words changed, dropped or added. Every
    document is searched whole, in every script. Documents without text and passages shorter than WINDOW words give no row.
    The passages are the stated query set. The driver holds one block of them at a time and builds its index once; the index
    is broadcast and the documents are read once a block. Where passages fit a place better or worse is decided over all blocks.
    """
    texts = documents.select("doc_id", "text").filter("text IS NOT NULL")
    given = cases.select("id", F.coalesce("reference_passage", F.lit("")).alias("passage")).filter("id IS NOT NULL").distinct()
    blocks = -(-max(1, given.count()) // BLOCK)
    context, out = documents.sparkSession.sparkContext, None
    for n in range(blocks):
        block = sorted(map(tuple, given.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()))
        sent = context.broadcast(PassageIndex(block))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for b in batches:
                # Alone, a block decides at once; else its places are kept for the comparison with those of the others.
                rows = [(b["doc_id"].iat[i], *h) for i, hits in sent.value.hits(b["text"].tolist()).items() for h in (hits if blocks > 1 else [(c, 0, 0, 0) for c in accounted(hits)])]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "case_id", "start", "stop", "edits"])

        part = texts.mapInPandas(search, "doc_id long, case_id string, start int, stop int, edits int")
        out = part if out is None else out.unionByName(part)
    if blocks > 1:

        def decide(hits: pd.DataFrame) -> pd.DataFrame:
            kept = accounted(list(hits[["case_id", "start", "stop", "edits"]].itertuples(index=False, name=None)))
            return pd.DataFrame({"doc_id": hits["doc_id"].iat[0], "case_id": kept})

        out = out.groupBy("doc_id").applyInPandas(decide, "doc_id long, case_id string")
    return out.select("doc_id", "case_id").distinct()


def found(documents: DataFrame, eval_case: DataFrame) -> DataFrame:
    """Columns doc_id, case_id."""
    return leaked(documents, eval_case)


def report(documents: DataFrame, eval_case: DataFrame) -> DataFrame:
    """Columns case_id, documents: in how many documents each leaked item stands."""
    return leaked(documents, eval_case).groupBy("case_id").agg(F.count("*").alias("documents"))
