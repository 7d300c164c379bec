"""Evaluation texts leaking into training text: a prefix-filtered set join of word shingles with exact verification.

An item leaks into a document if the document shows a run of `run_words` consecutive words of it. Shingles of five words are
compared in a coarse spelling that makes equal whatever `same_word` accepts, so such a run has all `run_words - 4` shingles of
one window of the item: the overlap that a window needs is its whole length, and its prefix in the global order by rarity is
a single shingle, the rarest one. Only these prefixes are indexed; nothing that verification would accept is lost.

(1) Rarity: how many documents hold each word of the items is counted over the whole corpus, and a shingle is as rare as its
words together. (2) One pass over the documents, in column order: their shingles are joined with the prefixes, which gives
(item, offset) candidates. An offset must leave room for a whole run in both texts (length bound) and have the coarse words
of one around the shingle (positional bound); then the words themselves are compared over the item-sized window.
No text is shuffled. The evaluation side is held in blocks of at most ITEMS_PER_BLOCK shingles; more items mean more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grainmill.llm.reading import byte_slices, coarse, pages_to_words, plain_words, same_word

SHINGLE, RUN_WORDS = 5, 20
#: Shingles of evaluation items per pass (about 100 bytes each on an executor).
ITEMS_PER_BLOCK = 2_000_000
#: Spellings whose number a task remembers; others are looked up anew.
KNOWN_WORDS = 300_000


class ItemIndex:
    """The items of one block: their words, and for each window of a run the rarest shingle with the places where it stands."""

    def __init__(self, items: list[tuple[int, str | None]], run_words: int = RUN_WORDS, shingle: int = SHINGLE) -> None:
        self.run_words, self.shingle = run_words, shingle
        same: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            ws = tuple(plain_words(t or ""))
            if len(ws) >= run_words:
                same.setdefault(ws, []).append(i)
        self.words, self.ids = [list(w) for w in same], list(same.values())
        self.number: dict[str, int] = {}
        self.seqs = [np.array([self.number.setdefault(coarse(w), len(self.number)) for w in ws], np.int64) for ws in self.words]
        self.prefix, self.item, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def order(self, freq: dict[str, int]) -> None:
        """Index the prefixes: of each window the shingle whose words are rarest by `freq`; ties fall to the same shingle everywhere."""
        keys, items, places = [self.prefix[:0]], [self.item[:0]], [self.place[:0]]
        size = self.run_words - self.shingle + 1
        for i, (ws, seq) in enumerate(zip(self.words, self.seqs, strict=True)):
            k = self.keys(seq)
            share = np.log1p(np.array([freq.get(w, 0) for w in ws], float))
            score = np.lib.stride_tricks.sliding_window_view(share, self.shingle).sum(axis=1)
            rank = np.empty(len(k), np.int64)
            rank[np.lexsort((k, score))] = np.arange(len(k))
            win = np.lib.stride_tricks.sliding_window_view(rank, size)
            at = np.unique(win.argmin(axis=1) + np.arange(len(win)))
            keys.append(k[at])
            items.append(np.full(len(at), i))
            places.append(at)
        key, item, place = np.concatenate(keys), np.concatenate(items), np.concatenate(places)
        o = np.argsort(key, kind="stable")
        self.prefix, self.item, self.place = key[o], item[o], place[o]

    def keys(self, seq: np.ndarray) -> np.ndarray:
        """A 64-bit key for each window of word numbers; 0 for a window with a word no item has."""
        n = len(seq) - self.shingle + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, gap = np.zeros(n, np.uint64), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            for j in range(self.shingle):
                part = seq[j : j + n]
                gap |= part < 0
                h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        h[gap] = 0
        return h

    def candidates(self, seq: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset) whose coarse words agree over a whole run around a prefix shingle of the text."""
        k = self.keys(seq)
        pos = np.flatnonzero(k)
        lo = np.searchsorted(self.prefix, k[pos], side="left")
        hi = np.searchsorted(self.prefix, k[pos], side="right")
        seen: dict[tuple[int, int], bool] = {}
        for p, a, b in zip(pos[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for e in range(a, b):
                i, off = int(self.item[e]), p - int(self.place[e])
                if (i, off) not in seen:
                    seen[i, off] = self._agree(self.seqs[i], seq, off)
        return {x for x, good in seen.items() if good}

    def _agree(self, item: np.ndarray, text: np.ndarray, off: int) -> bool:
        """Whether some run of coarse words at one offset (position in the text minus position in the item) is long enough."""
        lo, hi = max(0, -off), min(len(item), len(text) - off)
        if hi - lo < self.run_words:
            return False
        other = np.flatnonzero(np.r_[True, item[lo:hi] != text[lo + off : hi + off], True])
        return int(np.diff(other).max()) > self.run_words


def longest_run(item: list[str], words: list[str], offset: int) -> int:
    """The longest run of equal words at one offset (position in the text minus position in the item)."""
    best = run = 0
    for q in range(max(0, -offset), min(len(item), len(words) - offset)):
        run = run + 1 if same_word(item[q], words[q + offset]) else 0
        best = max(best, run)
    return best


def word_frequencies(docs: DataFrame, words: set[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of `words` stands, as split at whatever is neither letter nor digit. One row a word comes back."""
    wanted = docs.sparkSession.createDataFrame([(w,) for w in sorted(words)], "w string")
    tokens = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}]+"))
    found = docs.select(F.explode(tokens).alias("w")).join(F.broadcast(wanted), "w")  # the words of a block of items
    return {r["w"]: r["count"] for r in found.groupBy("w").count().toLocalIterator()}


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text_col: str = "text", boxes_col: str | None = "line_boxes", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, item_id, run): every document that shows `run_words` or more consecutive words of an item, with the longest run.

    One row per pair; all items of a document are reported. NULL and empty texts, and items of fewer words, match nothing.
    `boxes_col=None`, a missing column, or boxes that don't fit the lines: the text is read in its own order.
    Repeated keys are read row by row and reported once. Other columns aren't touched.
    """
    id_type, item_type = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    ddl = f"doc_id {id_type}, item_id {item_type}, run int"
    item_arrow = to_arrow_type(items.schema[item_key].dataType)
    out = docs.sparkSession.createDataFrame([], ddl)
    block: list[tuple[int, str | None]] = []
    size = 0
    for r in items.select(item_key, text_col).where(F.col(text_col).isNotNull()).distinct().orderBy(item_key, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 4
        if size >= ITEMS_PER_BLOCK:
            out, block, size = out.unionByName(_leaks_of(docs, block, ddl, doc_key, text_col, boxes_col, run_words, item_arrow)), [], 0
    if block:
        out = out.unionByName(_leaks_of(docs, block, ddl, doc_key, text_col, boxes_col, run_words, item_arrow))
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def _leaks_of(docs: DataFrame, block: list[tuple[int, str | None]], ddl: str, doc_key: str, text_col: str, boxes_col: str | None, run_words: int, item_arrow: pa.DataType) -> DataFrame:
    index = ItemIndex(block, run_words)
    if not index.words:
        return docs.sparkSession.createDataFrame([], ddl)
    index.order(word_frequencies(docs, {w for ws in index.words for w in ws}, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by ITEMS_PER_BLOCK
    has_boxes = boxes_col is not None and boxes_col in docs.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        known: dict[str, int] = {}

        def num(w: str) -> int:
            got = known.get(w)
            if got is None:
                got = ix.number.get(coarse(w), -1)
                if len(known) < KNOWN_WORDS:
                    known[w] = got
            return got

        for b in (part for whole in batches for part in byte_slices(whole, "t")):
            rows, item_ids, runs = [], [], []
            for row, words in enumerate(pages_to_words(b.column("t"), b.column("b") if has_boxes else None)):
                if len(words) < run_words:
                    continue
                best: dict[int, int] = {}
                for i, off in ix.candidates(np.fromiter(map(num, words), np.int64, len(words))):
                    run = longest_run(ix.words[i], words, off)
                    if run >= run_words:
                        best[i] = max(run, best.get(i, 0))
                for i, run in best.items():
                    for own in ix.ids[i]:  # items of the same words
                        rows.append(row)
                        item_ids.append(own)
                        runs.append(run)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows, pa.int64())), pa.array(item_ids, item_arrow), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "run"])

    cols = [docs[doc_key].alias("k"), docs[text_col].cast("string").alias("t")] + ([docs[boxes_col].alias("b")] if has_boxes else [])
    return docs.select(*cols).where("t IS NOT NULL").mapInArrow(join, ddl)
