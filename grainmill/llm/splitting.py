"""Cutting oversized texts at natural boundaries: balanced targets, snapped to the strongest boundary nearby.

A text of L tokens needs at least n = ceil((L - overlap) / (limit - overlap)) pieces. The cuts are aimed at equal lengths
and each is moved to the strongest boundary (blank line, line, end of sentence, clause, word, else any whole character)
within reach of its target; the piece after a cut begins `overlap` tokens before it, or a little more so as to begin with a
whole character. If a piece breaks the limit - in tokens of the whole text, or when its own text is counted alone - one more
piece is planned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.tokens import VOCABULARY, encoder, token_bytes

LIMIT, OVERLAP = 1024, 64
_FIRST = re.compile(r"\s*\S*\s*")
# Boundary strengths, strongest first.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, NONE = 6, 5, 4, 3, 2, 1, 0


def boundary_strengths(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of a cut after each token, given the byte offset where it ends."""
    b = np.frombuffer(data, np.uint8)
    at = ends[:-1]  # the end of the text isn't a cut
    before, after = b[at - 1], b[at]
    out = np.where((after & 0xC0) != 0x80, CHARACTER, NONE)
    blank = lambda x: (x == 32) | (x == 9) | (x == 10) | (x == 13)
    word = blank(before) | blank(after)
    out[word] = WORD
    last = np.where(blank(before) & (at >= 2), b[np.maximum(at - 2, 0)], before)
    out[word & np.isin(last, [44, 58, 59])] = CLAUSE
    out[word & np.isin(last, [33, 46, 63])] = SENTENCE
    line = (before == 10) | (after == 10)
    out[line] = LINE
    para = ((before == 10) & (at >= 2) & (b[np.maximum(at - 2, 0)] == 10)) | ((before == 10) & (after == 10)) | ((after == 10) & (at + 1 < len(b)) & (b[np.minimum(at + 1, len(b) - 1)] == 10))
    out[para] = PARAGRAPH
    return np.append(out, NONE)


def plan_cuts(strength: np.ndarray, limit: int, overlap: int, n: int) -> list[tuple[int, int]] | None:
    """Token ranges of n pieces, None if a limit fails. Piece i covers new tokens from the cut before it, and the overlap."""
    total = len(strength)
    whole = np.flatnonzero(strength > NONE) + 1  # token positions where a character ends
    cuts, reach = [0], max(1, (limit - overlap) // 8)
    for i in range(1, n):
        target = cuts[-1] + (total - cuts[-1]) / (n - i + 1)
        most = (cuts[-1] if i == 1 else _start(whole, cuts[-1], overlap)) + limit
        lo, hi = max(cuts[-1] + 1, round(target) - reach), min(round(target) + reach, most, total - 1)
        if lo > hi:
            return None
        span = strength[lo - 1 : hi]
        best = np.flatnonzero(span == span.max())
        if span.max() == NONE:
            return None
        cuts.append(int(lo + best[np.argmin(np.abs(best + lo - target))]))
    starts = [0] + [_start(whole, c, overlap) for c in cuts[1:]]
    pieces = list(zip(starts, [*cuts[1:], total], strict=True))
    return pieces if all(0 < e - s <= limit for s, e in pieces) else None


def _start(whole: np.ndarray, cut: int, overlap: int) -> int:
    """The last place at or before cut - overlap where a character begins."""
    want = cut - overlap
    if want <= 0:
        return 0
    i = int(np.searchsorted(whole, want, side="right"))
    return int(whole[i - 1]) if i else 0


def _outer_bytes(text: str) -> int:
    """Bytes of the first and the last word of a piece with the blanks around them: what may be tokenized otherwise than within its text."""
    first = _FIRST.match(text).end()
    tail = text.rstrip()
    last = max(tail.rfind(" "), tail.rfind("\n"))
    lead = len(text[:last].rstrip()) if last > 0 else 0
    return len(text[:first].encode("utf-8", "surrogatepass")) + len(text[lead:].encode("utf-8", "surrogatepass"))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> list[tuple[str, int, int, int]] | None:
    """Pieces (text, tokens, first token, byte offset) of a text above the limit; None for a text within it."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:  # a token has at least one byte
        return None
    enc = encoder(vocabulary)
    tokens = enc.encode_to_numpy(text, disallowed_special=())
    if len(tokens) <= limit:
        return None
    ends = np.cumsum(token_bytes(vocabulary)[tokens])
    strength = boundary_strengths(data, ends)
    begins = np.concatenate([[0], ends])
    n = -(-(len(tokens) - overlap) // (limit - overlap))
    while True:
        plan = plan_cuts(strength, limit, overlap, n)
        if plan:
            texts = [data[begins[s] : begins[e]].decode("utf-8", "surrogatepass") for s, e in plan]
            # interior words keep their tokens; only the outermost ones can need more, at most one a byte
            unsure = [t for t, (s, e) in zip(texts, plan, strict=True) if e - s + _outer_bytes(t) > limit]
            if all(len(enc.encode_ordinary(t)) <= limit for t in unsure):
                return [(t, e - s, s, int(begins[s])) for t, (s, e) in zip(texts, plan, strict=True)]
        n += 1
        if n > len(tokens):
            raise ValueError("a single character exceeds the limit")


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(<key>, piece, n_pieces, n_tokens, first_token, byte_offset, piece_text): the ordered pieces of every text above the limit.

    Texts within the limit, empty and NULL ones give no row. One narrow pass without a shuffle; nothing is held but a batch.
    """
    key_type = df.schema[key].dataType.simpleString()
    names = ["piece", "n_pieces", "n_tokens", "first_token", "byte_offset", "piece_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            long = pc.indices_nonzero(pc.greater(pc.binary_length(b.column("t")), limit))
            rows, cols = [], [[] for _ in names]
            for i in long.to_pylist():
                pieces = split_text(b.column("t")[i].as_py(), limit, overlap, vocabulary)
                for p, (t, n, first, offset) in enumerate(pieces or [], 1):
                    rows.append(i)
                    for c, x in zip(cols, (p, len(pieces), n, first, offset, t), strict=True):
                        c.append(x)
            if rows:
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["k", *names])

    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    return src.mapInArrow(run, f"k {key_type}, piece int, n_pieces int, n_tokens int, first_token int, byte_offset bigint, piece_text string").withColumnRenamed("k", key)
