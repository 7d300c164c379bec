"""Rows that fail to parse: a fast columnar path over blocks, isolation of failing lines, strict diagnosis of single lines.

`parse_lines` never drops a line. A block of lines of one feed is parsed as a whole with Arrow kernels, which vouch for the
lines they are certain of. Lines a block names as doubtful are isolated; a block that fails as a whole without naming any is
cut in halves until single lines remain. Isolated lines go to the strict parser, which alone decides the reason. So the
fast path may turn down a valid line (it costs a strict parse) but can never let a broken one through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

from grainmill.session import BLANKS

# The layout of the feeds and the reasons, in the order in which they apply.
CSV_FIELDS = ("user_key", "label", "age", "income", "city", "tags", "note")
CSV_NUMBERS = ("age", "income")
SPARSE_NUMBERS = ("age", "income", "dwell_sec", "bid")
REASONS = ("quotes", "columns", "label", "features")
MISSING = ("", "\\N")

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NUMBER = re.compile(NUMBER)
_UINT = re.compile("[0-9]+")
_QUOTED_BLOCK = r'^(?:"(?:[^"]|"")*"[ \t]*|[^",]*)(?:,(?:"(?:[^"]|"")*"[ \t]*|[^",]*)){6}$'

PARSED = pa.schema([
    ("reason", pa.string()),
    ("label", pa.float64()),
    ("names", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())),
    ("fields", pa.list_(pa.int64())),
    ("ids", pa.list_(pa.int64())),
    ("vals", pa.list_(pa.float64())),
])
PARSED_DDL = "reason string, label double, names array<string>, texts array<string>, fields array<bigint>, ids array<bigint>, vals array<double>"


# ---- strict path: one line ----------------------------------------------------------------------------------------------


def _number(s: str) -> float | None:
    if _NUMBER.fullmatch(s):
        x = float(s)
        if math.isfinite(x):
            return x
    return None


def _uint(s: str) -> int | None:
    return int(s) if _UINT.fullmatch(s) and len(s.lstrip("0")) <= 19 and int(s) < 2**63 else None


def _label(s: str) -> float | None:
    x = _number(s)
    return x if x in (-1.0, 0.0, 1.0) else None


def split_quoted(line: str) -> list[str] | None:
    """The fields of a csv line; None if its quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in BLANKS:
            i += 1
        if i < n and line[i] == '"':
            part, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                part.append(line[i:j])
                if line[j + 1 : j + 2] != '"':
                    break
                part.append('"')
                i = j + 2
            i = j + 1
            while i < n and line[i] in BLANKS:
                i += 1
            if i < n and line[i] != ",":
                return None
            fields.append("".join(part).strip(BLANKS))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j].strip(BLANKS))
            i = j
        if i >= n:
            return fields
        i += 1


def _failed(reason: str) -> dict:
    return dict.fromkeys(PARSED.names) | {"reason": reason}


def parse_strict(feed: str | None, line: str | None) -> dict:
    """One line by the rules; `reason` is None where it is usable. A line of an unknown feed has no layout: `columns`."""
    line = (line or "").strip(BLANKS)
    out = dict.fromkeys(PARSED.names)
    if feed == "csv":
        fields = split_quoted(line)
        if fields is None:
            return _failed("quotes")
        if not line or len(fields) != len(CSV_FIELDS):
            return _failed("columns")
        row = dict(zip(CSV_FIELDS, fields, strict=True))
        label = None if row["label"] in MISSING else _label(row["label"])
        if label is None and row["label"] not in MISSING:
            return _failed("label")
        if any(row[c] not in MISSING and _number(row[c]) is None for c in CSV_NUMBERS):
            return _failed("features")
        names = [c for c in CSV_FIELDS if c != "label"]
        return out | {"label": label, "names": names, "texts": [None if row[c] in MISSING else row[c] for c in names]}
    if not line:
        return _failed("columns")
    if feed == "sparse":
        pairs = [[p.strip(BLANKS) for p in e.split(":")] for e in line.split(",")]
        if any(len(p) != 2 for p in pairs):
            return _failed("columns")
        label = next((v for k, v in pairs if k == "label"), None)
        if label is None or _label(label) is None:
            return _failed("label")
        if any(k in SPARSE_NUMBERS and _number(v) is None for k, v in pairs):
            return _failed("features")
        rest = [p for p in pairs if p[0] != "label"]
        return out | {"label": _label(label), "names": [k for k, _ in rest], "texts": [None if v in MISSING else v for _, v in rest]}
    if feed in ("libsvm", "libffm"):
        width = 2 if feed == "libsvm" else 3
        label, *feats = line.split()
        parts = [f.split(":") for f in feats]
        if not parts or any(len(p) != width for p in parts):
            return _failed("columns")
        if _label(label) is None:
            return _failed("label")
        heads, vals = [[_uint(x) for x in p[:-1]] for p in parts], [_number(p[-1]) for p in parts]
        if any(x is None for h in heads for x in h) or any(v is None for v in vals):
            return _failed("features")
        return out | {"label": _label(label), "fields": [h[0] for h in heads] if width == 3 else None, "ids": [h[-1] for h in heads], "vals": vals}
    return _failed("columns")


# ---- fast path: a block of lines ----------------------------------------------------------------------------------------
#
# Each parser works on whole columns and gives (ok, columns): which lines of the block are certainly valid, and the parsed
# columns of just these, in order.


def _floats(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Doubles of numbers in text, and which values are finite decimals (NULL is in order and stays NULL)."""
    fits = pc.fill_null(pc.match_substring_regex(texts, f"^{NUMBER}$"), True)
    x = pc.cast(pc.replace_substring_regex(pc.if_else(fits, texts, pa.scalar(None, pa.string())), r"^\+", ""), pa.float64())
    return x, pc.and_(fits, pc.fill_null(pc.is_finite(x), True)).to_numpy(zero_copy_only=False)


def _labels(texts: pa.Array, missing: bool = False) -> tuple[pa.Array, np.ndarray]:
    x, ok = _floats(texts)
    known = pc.is_in(x, value_set=pa.array([-1.0, 0.0, 1.0]))
    return x, ok & (pc.or_(known, pc.is_null(texts)) if missing else known).to_numpy(zero_copy_only=False)


def _indices(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Unsigned integers below 2^63 of at most 19 digits (longer ones can only be valid with leading zeros)."""
    fits = pc.and_(pc.ascii_is_decimal(texts), pc.less_equal(pc.binary_length(texts), 19))
    x = pc.cast(pc.if_else(fits, texts, "0"), pa.uint64()).to_numpy()
    below = x < np.uint64(2**63)
    return pa.array(np.where(below, x, 0).astype(np.int64)), fits.to_numpy(zero_copy_only=False) & below


def _blank_to_null(texts: pa.Array) -> pa.Array:
    return pc.if_else(pc.is_in(texts, value_set=pa.array(MISSING)), pa.scalar(None, pa.string()), texts)


def _interleave(cols: list[pa.Array], n: int) -> pa.Array:
    """A list per row with the value of each column."""
    k = len(cols)
    flat = pa.concat_arrays(cols)
    at = pa.array(np.arange(n * k).reshape(k, n).T.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), flat.take(at))


def _lists(lens: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), flat)


def _block_csv(lines: pa.Array) -> tuple[np.ndarray, dict]:
    shape = pc.and_(pc.match_substring_regex(lines, _QUOTED_BLOCK), pc.invert(pc.match_substring_regex(lines, "[\n\r]")))
    ok = shape.to_numpy(zero_copy_only=False).copy()
    rows = lines.filter(pa.array(ok))
    data = "\n".join(rows.to_pylist()).encode()
    if not len(rows):
        return ok, {}
    t = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(column_names=list(CSV_FIELDS), use_threads=False, block_size=max(len(data) + 1, 1024)),
        parse_options=pacsv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(CSV_FIELDS, pa.string()), strings_can_be_null=False),
    )
    if t.num_rows != len(rows):
        raise pa.ArrowInvalid("rows of the block don't match its lines")
    col = {c: _blank_to_null(pc.utf8_trim(t[c].combine_chunks(), BLANKS)) for c in CSV_FIELDS}
    label, good = _labels(col["label"], missing=True)
    for c in CSV_NUMBERS:
        good = good & _floats(col[c])[1]
    ok[ok] = good
    keep, n = pa.array(good), int(good.sum())
    names = [c for c in CSV_FIELDS if c != "label"]
    repeated = _lists(np.full(n, len(names)), pa.array(names * n, pa.string()))
    return ok, {"label": label.filter(keep), "names": repeated, "texts": _interleave([col[c].filter(keep) for c in names], n)}


def _block_sparse(lines: pa.Array) -> tuple[np.ndarray, dict]:
    ok = pc.match_substring_regex(lines, r"^[^:,]*:[^:,]*(?:,[^:,]*:[^:,]*)*$").to_numpy(zero_copy_only=False).copy()
    elements = pc.split_pattern(lines.filter(pa.array(ok)), ",")
    lens = pc.list_value_length(elements).to_numpy()
    kv = pc.utf8_trim(pc.split_pattern(elements.flatten(), ":").flatten(), BLANKS)
    at = np.arange(0, len(kv), 2)
    keys, vals = kv.take(pa.array(at)), kv.take(pa.array(at + 1))
    owner = np.repeat(np.arange(len(lens)), lens)
    is_label = pc.equal(keys, "label").to_numpy(zero_copy_only=False)
    good = np.bincount(owner[is_label], minlength=len(lens)) == 1
    is_num = pc.is_in(keys, value_set=pa.array(SPARSE_NUMBERS)).to_numpy(zero_copy_only=False)
    good[owner[is_num][~_floats(vals.filter(pa.array(is_num)))[1]]] = False
    label, valid = _labels(vals.filter(pa.array(is_label)))
    good[owner[is_label][~valid]] = False
    ok[ok] = good
    rest = pa.array(good[owner] & ~is_label)
    return ok, {"label": label.filter(pa.array(good[owner[is_label]])), "names": _lists(lens[good] - 1, keys.filter(rest)), "texts": _lists(lens[good] - 1, _blank_to_null(vals.filter(rest)))}


def _block_ids(width: int) -> Callable[[pa.Array], tuple[np.ndarray, dict]]:
    def block(lines: pa.Array) -> tuple[np.ndarray, dict]:
        tokens = pc.split_pattern_regex(lines, "[ \t\r\n\f\v]+")
        lens = pc.list_value_length(tokens).to_numpy() - 1
        label, valid = _labels(pc.list_element(tokens, 0))
        ok = valid & (lens >= 1)
        parts = pc.split_pattern(pc.list_slice(tokens, 1).flatten(), ":")
        owner = np.repeat(np.arange(len(lens)), lens)
        ok[owner[pc.list_value_length(parts).to_numpy() != width]] = False
        whole = ok[owner]
        flat, owner = parts.filter(pa.array(whole)).flatten(), owner[whole]
        column = [flat.take(pa.array(np.arange(i, len(flat), width))) for i in range(width)]
        good = np.ones(len(owner), bool)
        heads = []
        for c in column[:-1]:
            x, fits = _indices(c)
            heads.append(x)
            good &= fits
        vals, fits = _floats(column[-1])
        ok[owner[~(good & fits)]] = False
        keep, lens = pa.array(ok[owner]), lens[ok]
        out = {"label": label.filter(pa.array(ok)), "ids": _lists(lens, heads[-1].filter(keep)), "vals": _lists(lens, vals.filter(keep))}
        return ok, out | ({"fields": _lists(lens, heads[0].filter(keep))} if width == 3 else {})

    return block


FAST: dict[str, Callable[[pa.Array], tuple[np.ndarray, dict]]] = {"csv": _block_csv, "sparse": _block_sparse, "libsvm": _block_ids(2), "libffm": _block_ids(3)}


def _as_batch(cols: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if (c := cols.get(f.name)) is not None else pa.nulls(n, f.type) for f in PARSED], schema=PARSED)


def parse_pieces(feed: str | None, lines: pa.Array, calls: list | None = None, strict: list | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The lines of a block in pieces: (places of the lines, what was parsed from them); every line is in exactly one piece.

    A bulk parse that isn't sure of every line names those it turns down, and these are isolated at once; one that fails
    without naming any (a kernel raises) is cut in halves, down to single lines. Isolated lines go to the strict parser.
    `calls` collects the sizes of the bulk parses, `strict` the places of isolated lines.
    """
    fast = FAST.get(feed)
    trimmed = pc.utf8_trim(pc.fill_null(lines, ""), BLANKS)
    alone: list[np.ndarray] = []
    stack = [np.arange(len(lines))]
    while stack:
        at = stack.pop()
        if fast is None or not len(at):
            alone.append(at)
            continue
        if calls is not None:
            calls.append(len(at))
        try:
            ok, cols = fast(trimmed if len(at) == len(lines) else trimmed.take(pa.array(at)))
        except pa.ArrowException:
            if len(at) == 1:
                alone.append(at)
            else:
                stack += [at[len(at) // 2 :], at[: len(at) // 2]]
            continue
        if ok.any():
            yield at[ok], _as_batch(cols, int(ok.sum()))
        alone.append(at[~ok])
    left = np.sort(np.concatenate(alone)) if alone else np.zeros(0, np.int64)
    if strict is not None:
        strict += left.tolist()
    if len(left):
        yield left, pa.RecordBatch.from_pylist([parse_strict(feed, x) for x in lines.take(pa.array(left)).to_pylist()], schema=PARSED)


def parse_block(feed: str | None, lines: pa.Array, calls: list | None = None, strict: list | None = None) -> pa.Table:
    """What was parsed from all lines of a block, in their order."""
    pieces = list(parse_pieces(feed, lines, calls, strict))
    if not pieces:
        return PARSED.empty_table()
    order = np.argsort(np.concatenate([at for at, _ in pieces]))
    return pa.Table.from_batches([b for _, b in pieces], schema=PARSED).combine_chunks().take(pa.array(order))


def parse_lines(df: DataFrame, keys: tuple[str, ...] = ("line_no",), feed_col: str = "feed", line_col: str = "line", block_rows: int = 4096) -> DataFrame:
    """Every row of `df` as its `keys`, its feed and what was parsed from its line.

    Added columns: reason (NULL = usable; else the first of REASONS that applies), label, names/texts (csv and sparse
    features, missing values NULL), fields/ids/vals (libsvm and libffm features). Other columns of `df` are not carried,
    so clashing names do no harm. NULL and blank lines fail with `columns`; an empty table gives an empty table.
    One narrow pass, no shuffle; a task holds one Arrow batch.
    """
    kept = [f for f in df.schema.fields if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", feed string, {PARSED_DDL}"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feeds = b.column("__feed")
            for feed in pc.unique(feeds).to_pylist():
                at = pc.indices_nonzero(pc.fill_null(pc.equal(feeds, feed), False) if feed is not None else pc.is_null(feeds))
                own = b.take(at)
                lines = own.column("__line")
                for lo in range(0, len(lines), block_rows):
                    part = own.slice(lo, block_rows)
                    for at, piece in parse_pieces(feed, lines.slice(lo, block_rows)):
                        of = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*(of.column(n) for n in names), of.column("__feed"), *piece.columns], names=[*names, "feed", *PARSED.names])

    src = df.select(*names, df[feed_col].alias("__feed"), df[line_col].cast("string").alias("__line"))
    return src.mapInArrow(run, ddl)


def failed_lines(df: DataFrame, **kw) -> DataFrame:
    """The lines that fail, with their keys, feed and reason."""
    parsed = parse_lines(df, **kw)
    keys = parsed.columns[: parsed.columns.index("feed")]
    return parsed.filter("reason IS NOT NULL").select(*keys, "feed", "reason")


def loaded_lines(df: DataFrame, **kw) -> DataFrame:
    """The usable lines as label and features."""
    return parse_lines(df, **kw).filter("reason IS NULL").drop("reason")
