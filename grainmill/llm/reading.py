"""Reading scanned pages: lines back into column order, broken words joined, furniture set aside, letters made comparable."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A new column begins where the left edges of a page jump by more than so many line heights.
COLUMN_GAP_LINES = 5.0
#: Lines set in by more than so many line heights from their column's edge are adverts and running heads; they are read after the page.
ASIDE_LINES = 1.0
#: Blanks between two columns that the scan put into one line, and lines of a page that must have such a gap at one place.
GAP_BLANKS, GAP_LINES = 3, 3
#: Lines between two rulers of asterisks that count as an advert.
RULED_LINES = 5

# Letters that scans confuse. A pair of letters first, then classes of single letters.
LETTER_PAIRS = {"m": "rn", "d": "cl", "w": "vv", "ü": "ii"}
LETTER_CLASSES = ("ec", "ril1", "tf", "ao0ä", "hb", "nu", "s5", "gq", "yv")
# Confusions of capitals, which would join too many classes; `same_word` admits them.
CAPITAL_CONFUSIONS = {("e", "f"), ("t", "1"), ("b", "8"), ("s", "8"), ("i", "t"), ("g", "c"), ("o", "q")}
HYPHENS = "-­¬="

_CLASS = {c: k[0] for k in LETTER_CLASSES for c in k}


def _coarse_classes() -> dict[str, str]:
    """Letter classes in which the confusions of capitals are joined too. In a fixed order: driver and executors must agree on the names."""
    pairs = sorted((_CLASS.get(a, a), _CLASS.get(b, b)) for a, b in CAPITAL_CONFUSIONS)
    name = {c: c for pair in pairs for c in pair}
    for a, b in pairs:
        x, y = sorted((name[a], name[b]))
        name = {c: x if k == y else k for c, k in name.items()}
    return {c: name.get(k, k) for c, k in [*_CLASS.items(), *((c, c) for c in name)]}


_COARSE = _coarse_classes()
_GAP = re.compile(f"(?<=\\S) {{{GAP_BLANKS},}}(?=\\S)")
_RULER = re.compile(r"[ \t]*(?:\*[ \t]*){3,}")
_JOIN = re.compile(f"[{re.escape(HYPHENS)}][ \t]*\n[ \t]*")


class _Plain(dict):
    """str.translate table: letters and digits in lower case, blanks as they are, everything else dropped."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        v = c.lower() if c.isalnum() else (" " if c.isspace() else "")
        self[code] = v
        return v


_PLAIN = _Plain()


@lru_cache(maxsize=1 << 18)
def canonical(word: str) -> str:
    """A word with every letter replaced by the name of what it may be misread for: equal for all misreadings of one word."""
    expanded = "".join(LETTER_PAIRS.get(c, c) for c in word)
    return "".join(_CLASS.get(c, c) for c in expanded)


@lru_cache(maxsize=1 << 18)
def coarse(word: str) -> str:
    """As `canonical`, with confusions of capitals made equal too: any two words that `same_word` accepts have the same coarse form."""
    return "".join(_COARSE.get(c, c) for c in canonical(word))


@lru_cache(maxsize=1 << 16)
def same_word(a: str, b: str) -> bool:
    """Whether one word may be the other one misread: equal in canonical form, or but for one confusion of capitals."""
    x, y = canonical(a), canonical(b)
    if x == y:
        return True
    if len(a) == len(b) and len(a) > 2:
        diff = [(p, q) for p, q in zip(a, b, strict=True) if _CLASS.get(p, p) != _CLASS.get(q, q)]
        return len(diff) == 1 and ((diff[0] in CAPITAL_CONFUSIONS) or (diff[0][::-1] in CAPITAL_CONFUSIONS))
    return False


def plain_words(text: str) -> list[str]:
    """The words of a running text: lower case, punctuation dropped."""
    return text.translate(_PLAIN).split()


def _flat_boxes(boxes: pa.Array, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left edge, top and height of every line of the batch; `ok` per text: one box a line. A line without a complete box takes the place of its neighbour in the scan."""
    if not pa.types.is_list(boxes.type) and not pa.types.is_large_list(boxes.type):
        return np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(len(n_lines), bool)
    n_boxes = pc.fill_null(pc.list_value_length(boxes), -1).to_numpy(zero_copy_only=False)
    flat = boxes.flatten()
    get = lambda f: pc.fill_null(pc.cast(pc.struct_field(flat, f), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    x0, x1, y0, y1 = get("x0"), get("x1"), get("y0"), get("y1")
    bad = np.isnan(x0) | np.isnan(x1) | np.isnan(y0) | np.isnan(y1)
    owner = np.repeat(np.arange(len(n_lines)), np.maximum(n_boxes, 0))
    ok = (n_boxes == n_lines) & (np.bincount(owner, weights=~bad, minlength=len(n_lines)) > 0)
    if bad.any():
        at = np.where(bad, -1, np.arange(len(bad)))
        before = np.maximum.accumulate(at)
        after = np.minimum.accumulate(np.where(bad, len(bad), np.arange(len(bad)))[::-1])[::-1]
        same = (before >= 0) & (owner[before] == owner)
        use = np.where(same, before, np.minimum(after, len(bad) - 1))
        x0, x1, y0, y1 = x0[use], x1[use], y0[use], y1[use]
    keep = ok[owner]
    return np.minimum(x0, x1)[keep], np.minimum(y0, y1)[keep], np.abs(y1 - y0)[keep], ok


def _merged_columns(lines: list[str]) -> list[tuple[int, list[tuple[int, str]]]]:
    """Lines that hold several columns side by side: (line, its parts as (column, text)).

    Columns side by side begin at the same character in many lines of a page. `column` counts these places from 1; the part
    before the first one isn't listed.
    """
    ends: dict[int, int] = {}
    for t in lines:
        for m in _GAP.finditer(t):
            ends[m.end()] = ends.get(m.end(), 0) + 1
    starts: list[int] = []
    for e, n in sorted(ends.items(), key=lambda x: (-x[1], x[0])):
        if n >= GAP_LINES and all(abs(e - x) > 8 for x in starts):
            starts.append(e)
    starts.sort()
    out = []
    for i, t in enumerate(lines):
        parts, last = [], len(t)
        for c in range(len(starts), 0, -1):
            e = starts[c - 1]
            if e < last and t[:e].strip() and not t[e - 2 : e].strip() and t[e:last].strip():
                parts.append((c, t[e:last]))
                last = e
        if parts:
            out.append((i, [(0, t[:last]), *parts[::-1]]))
    return out


def _without_ruled(lines: list[str]) -> tuple[list[str], list[str]]:
    """The lines of a column, and those of adverts between two rulers of asterisks. A ruler that isn't closed soon sets only itself aside."""
    main, aside, i = [], [], 0
    while i < len(lines):
        if _RULER.fullmatch(lines[i]):
            j = next((j for j in range(i + 1, min(i + 2 + RULED_LINES, len(lines))) if _RULER.fullmatch(lines[j])), i)
            aside += lines[i + 1 : j]
            i = j + 1
        else:
            main.append(lines[i])
            i += 1
    return main, aside


def read_pages(texts: pa.Array, boxes: pa.Array | None) -> list[tuple[str, str]]:
    """Of each text what stands in its columns, one after the other, and what is set aside; words broken over lines are joined.

    Columns that the scan put side by side into one line are taken apart at the gap. A text without a box for each line keeps
    the order of its lines but for these. Nothing is lost: every part of every line is in one of the two. NULL gives "", "".
    """
    raw = [t or "" for t in texts.to_pylist()]
    lines = [t.split("\n") for t in raw]
    n = np.array([len(x) for x in lines], np.int64)
    merged = {d: m for d, t in enumerate(raw) if t.count(" " * GAP_BLANKS) >= GAP_LINES and (m := _merged_columns(lines[d]))}
    out: list[tuple[list[str], list[str]]] = [(x, []) for x in lines]
    left, top, height, ok = _flat_boxes(boxes, n) if boxes is not None and len(raw) else (np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(len(raw), bool))
    for d in merged:
        if not ok[d]:  # every column in turn, lines without a gap belong to the first
            parts = {i: dict(p) for i, p in merged[d]}
            width = 1 + max(c for p in parts.values() for c in p)
            rows = [parts.get(i, {0: t}) for i, t in enumerate(lines[d])]
            out[d] = ([r[c] for c in range(width) for r in rows if c in r], [])
    which = np.flatnonzero(ok)
    if len(which):
        doc = np.repeat(which, n[which])
        starts = np.concatenate([[0], np.cumsum(n[which])[:-1]])
        line_no = np.arange(len(doc)) - np.repeat(starts, n[which])
        by_h = np.lexsort((height, doc))
        unit_of = np.maximum(height[by_h][starts + n[which] // 2], 1.0)
        unit = np.repeat(unit_of, n[which])
        flat = [t for d in which.tolist() for t in lines[d]]
        more: list[tuple[int, float, float, float, int, str]] = []
        for k, d in enumerate(which.tolist()):
            if d not in merged:
                continue
            base, u = int(starts[k]), float(unit_of[k])
            own = left[base : base + int(n[d])]
            single = np.ones(len(own), bool)
            single[[i for i, _ in merged[d]]] = False
            xs = np.sort(own[single])
            edges = xs[np.flatnonzero(np.r_[True, np.diff(xs) > COLUMN_GAP_LINES * u])] if len(xs) else xs
            first = float(own.min())
            beyond = [float(e) for e in edges if e > first + COLUMN_GAP_LINES * u]
            for i, parts in merged[d]:
                flat[base + i] = parts[0][1]
                for c, t in parts[1:]:
                    x = beyond[c - 1] if c <= len(beyond) else max([first, *beyond]) + c * 4 * COLUMN_GAP_LINES * u
                    more.append((d, x, float(top[base + i]), u, i, t))
        if more:
            d_, x_, t_, u_, i_, s_ = zip(*more, strict=True)
            doc, left, top, unit = np.append(doc, d_), np.append(left, x_), np.append(top, t_), np.append(unit, u_)
            line_no = np.append(line_no, i_)
            flat += s_
        by_x = np.lexsort((left, doc))
        dx, xx = doc[by_x], left[by_x]
        new = np.ones(len(dx), bool)
        new[1:] = (dx[1:] != dx[:-1]) | (xx[1:] - xx[:-1] > COLUMN_GAP_LINES * unit[by_x][1:])
        col_sorted = np.cumsum(new) - 1
        edge = xx[new][col_sorted]
        column, aside = np.empty(len(dx), np.int64), np.empty(len(dx), bool)
        column[by_x], aside[by_x] = col_sorted, xx - edge > ASIDE_LINES * unit[by_x]
        order = np.lexsort((line_no, top, column, aside, doc))
        cuts = np.searchsorted(doc[order], which)
        ends = np.append(cuts[1:], len(order))
        for d, lo, hi in zip(which.tolist(), cuts.tolist(), ends.tolist(), strict=True):
            own = order[lo:hi]
            k = len(own) - int(aside[own].sum())
            out[d] = ([flat[i] for i in own[:k].tolist()], [flat[i] for i in own[k:].tolist()])
    for d, t in enumerate(raw):
        if t.count("*") >= 6:
            main, ruled = _without_ruled(out[d][0])
            out[d] = (main, out[d][1] + ruled)
    return [(_JOIN.sub("", "\n".join(a)) if len(a) > 1 else "".join(a), "\n".join(b)) for a, b in out]


def pages_to_text(texts: pa.Array, boxes: pa.Array | None) -> list[str]:
    """What stands in the columns of each text."""
    return [a for a, _ in read_pages(texts, boxes)]


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least: what is split into words at a time stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def pages_to_words(texts: pa.Array, boxes: pa.Array | None) -> list[list[str]]:
    """The words of each text, those set aside at the end, after an empty word that no other equals."""
    return [[*plain_words(a), "", *plain_words(b)] if b else plain_words(a) for a, b in read_pages(texts, boxes)]
