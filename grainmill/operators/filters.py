"""Row and feature filters over delimited feature records, and the small rule language that configures them.

Record: `label \\x01 name\\x03class\\x02value \\x01 ...` (a tab ends a value as well). Rules: sections `[filter=1]` (drop matching
records), `[filter=0]` (keep only matching ones) and `[col]` (drop features); `k={a,b}` is a set of classes, `k=[min,max]` a
closed range with `#` for an open bound, and `;` joins conditions that must all hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.schema import EngineError


@dataclass(frozen=True)
class Condition:
    """One feature, and the classes or the range it must have."""

    name: str
    classes: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class FilterRules:
    """Each inner list is a conjunction. `drop`: a record goes if any holds. `keep`: a record goes if it has the features and they don't hold."""

    drop: list[list[Condition]] = field(default_factory=list)
    keep: list[list[Condition]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)


def _condition(text: str) -> Condition:
    name, _, spec = text.partition("=")
    name, spec = name.strip(), spec.strip()
    if spec.startswith("{") and spec.endswith("}"):
        return Condition(name, classes=tuple(x.strip() for x in spec[1:-1].split(",")))
    if spec.startswith("[") and spec.endswith("]") and spec.count(",") == 1:
        low, high = (None if x.strip() == "#" else float(x) for x in spec[1:-1].split(","))
        return Condition(name, low=low, high=high)
    raise EngineError(f"not a condition: {text!r}")


def parse_rules(text: str) -> FilterRules:
    """The rules of a configuration text; `#` at the start of a line begins a comment."""
    rules, section = FilterRules(), None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        head = re.fullmatch(r"\[\s*(filter\s*=\s*[01]|col)\s*\]", line)
        if head:
            section = re.sub(r"\s", "", head[1])
        elif section == "col":
            name, _, flag = line.partition("=")
            if flag.strip() == "1":
                rules.columns.append(name.strip())
        elif section is None:
            raise EngineError(f"a rule before any section: {raw!r}")
        else:
            (rules.drop if section == "filter=1" else rules.keep).append([_condition(c) for c in line.split(";") if c.strip()])
    return rules


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """The other columns of `lines`, label and feats array<struct<name, cls, value>>; value is NULL where it isn't a number."""
    parts = F.split(F.col(line), "\x01")
    body = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(F.get(F.split(x, "\t"), 0)))

    def feat(x: Column) -> Column:
        name, rest = F.get(F.split(x, "\x03", 2), 0), F.get(F.split(x, "\x03", 2), 1)
        return F.struct(F.trim(name).alias("name"), F.get(F.split(rest, "\x02", 2), 0).alias("cls"), F.get(F.split(rest, "\x02", 2), 1).try_cast("double").alias("value"))

    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, F.trim(F.get(parts, 0)).alias("label"), F.transform(F.filter(body, lambda x: x.contains("\x03")), feat).alias("feats"))


def condition_holds(c: Condition, feats: str | Column = "feats") -> Column:
    """Whether some feature of that exact name has one of the classes, or a value in the range. A value that is no number never matches."""

    def test(f: Column) -> Column:
        ok = f["name"] == c.name
        if c.classes is not None:
            return ok & f["cls"].isin(list(c.classes))
        ok = ok & f["value"].isNotNull() & ~F.isnan(f["value"])
        if c.low is not None:
            ok = ok & (f["value"] >= c.low)
        return ok & (f["value"] <= c.high) if c.high is not None else ok

    return F.coalesce(F.exists(feats, test), F.lit(False))


def condition_present(c: Condition, feats: str | Column = "feats") -> Column:
    """Whether the record has the feature (for ranges: with a number)."""
    return F.coalesce(F.exists(feats, lambda f: (f["name"] == c.name) & (F.lit(True) if c.classes is not None else f["value"].isNotNull())), F.lit(False))


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def drop_predicate(rules: FilterRules, feats: str = "feats", ranges: bool | None = None) -> Column:
    """Records the rules remove. `ranges`: only rules of ranges (True) or of classes (False)."""
    pick = lambda cs: ranges is None or all((c.classes is None) == ranges for c in cs)

    def removed(f: Column) -> Column:
        out = F.lit(False)
        for cs in filter(pick, rules.drop):
            out = out | _all([condition_holds(c, f) for c in cs])
        for cs in filter(pick, rules.keep):
            out = out | (_all([condition_present(c, f) for c in cs]) & ~_all([condition_holds(c, f) for c in cs]))
        return out

    # bound as a lambda's variable, so that the record is parsed once and not once a condition
    return F.coalesce(F.get(F.transform(F.array(F.col(feats)), removed), 0), F.lit(False))


def filter_records(records: DataFrame, rules: FilterRules, feats: str = "feats") -> DataFrame:
    """The records the rules leave, without the features they drop."""
    kept = records.where(~drop_predicate(rules, feats))
    if not rules.columns:
        return kept
    return kept.withColumn(feats, F.filter(feats, lambda f: ~f["name"].isin(rules.columns)))


def hash_records(records: DataFrame, hasher=None, feats: str = "feats") -> DataFrame:  # noqa: ANN001
    """label, ids, vals: each feature as the hash of `name\\x03class` and its value. `hasher` maps a string column to bigint."""
    hasher = hasher or F.xxhash64
    keep = [c for c in records.columns if c != feats]
    return records.select(*keep, F.transform(feats, lambda f: hasher(F.concat_ws("\x03", f["name"], f["cls"]))).alias("ids"), F.transform(feats, lambda f: f["value"].cast("float")).alias("vals"))
