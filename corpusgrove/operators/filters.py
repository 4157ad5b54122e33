"""The filter language.

A criteria string is parsed once on the driver into one boolean Column; the
DataFrame is filtered with it, so Catalyst pushes the comparisons on ``ts``,
``ref``, ``predict`` and ``target`` into the Parquet scan and the text regex
runs as a post-scan filter inside whole-stage codegen.

Grammar: conjuncts separated by ``&&``; each conjunct is one of
``ts:<cond>[,<cond>...]`` (``>a``, ``<b`` or ``c``; all must hold),
``ref:<value>``, ``predict:<list>``, ``target:<list>``, or a text regex.
A list is ``1,3,5-10`` (inclusive ranges); items that do not parse are
skipped and a list with nothing valid makes its conjunct a no-op.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = re.compile(r"([0-9]+)-([0-9]+)")


class FilterSyntaxError(ValueError):
    pass


@dataclass
class IdList:
    """Parsed integer list; ranges stay ranges (never expanded)."""
    singles: list[int] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not self.singles and not any(lo <= hi for lo, hi in self.ranges)

    def to_column(self, col: Column) -> Column | None:
        parts = [col.between(lo, hi) for lo, hi in self.ranges if lo <= hi]
        if self.singles:
            parts.append(col.isin(sorted(set(self.singles))))
        if not parts:
            return None
        return reduce(lambda a, b: a | b, parts)

    def contains(self, v: int) -> bool:
        return v in self.singles or any(lo <= v <= hi for lo, hi in self.ranges)


def parse_id_list(text: str) -> IdList:
    """``1,3,5-10``; ``-1`` is minus one; bad items are skipped."""
    out = IdList()
    for item in text.split(","):
        m = _RANGE.search(item)
        if m:
            out.ranges.append((int(m.group(1)), int(m.group(2))))
            continue
        try:
            out.singles.append(int(item))
        except ValueError:
            continue
    return out


def _parse_ts(value: str) -> Column:
    import pandas as pd
    try:
        ts = pd.Timestamp(value.strip())
    except (ValueError, TypeError) as e:
        raise FilterSyntaxError(f"bad timestamp {value!r}") from e
    if ts.tzinfo is not None:
        ts = ts.tz_convert("UTC").tz_localize(None)
    return F.lit(ts.isoformat()).cast("timestamp_ntz")


def ts_predicate(spec: str) -> Column | None:
    """``>a``, ``<b`` or exact ``c``, comma = AND; null ts never matches."""
    preds = []
    for c in spec.split(","):
        c = c.strip()
        if not c:
            continue
        if c[0] == ">":
            preds.append(F.col("ts") > _parse_ts(c[1:]))
        elif c[0] == "<":
            preds.append(F.col("ts") < _parse_ts(c[1:]))
        else:
            preds.append(F.col("ts") == _parse_ts(c))
    return reduce(lambda a, b: a & b, preds) if preds else None


def text_predicate(pattern: str, literal: bool = False, lower_both: bool = False) -> Column:
    """Case-insensitive regex search on ``text``.

    Default keeps the pattern unchanged under ``(?iu)``, so that letters beyond
    ASCII fold as well (lower-casing a regex
    would turn ``\\D`` into ``\\d``); ``lower_both=True`` lower-cases text and
    pattern as the reference does; ``literal=True`` matches a plain substring.
    """
    if literal:
        return F.lower(F.col("text")).contains(pattern.lower())
    if lower_both:
        return F.lower(F.col("text")).rlike(pattern.lower())
    return F.col("text").rlike("(?iu)" + pattern)


def _strip_prefix(s: str, prefix: str) -> str:
    return s[len(prefix):].strip()


def compile_criteria(criteria: str | None, lenient: bool = False, literal_text: bool = False,
                     lower_both: bool = False) -> Column | None:
    """Criteria string -> one Column (None means no filter).

    Errors raise :class:`FilterSyntaxError`; ``lenient=True`` skips a bad
    conjunct and keeps the others.
    """
    if criteria is None:
        return None
    preds = []
    for raw in criteria.split("&&"):
        c = raw.strip()
        try:
            if c.startswith("ts:"):
                p = ts_predicate(_strip_prefix(c, "ts:"))
            elif c.startswith("ref:"):
                p = F.col("ref") == _strip_prefix(c, "ref:")
            elif c.startswith("predict:"):
                p = parse_id_list(_strip_prefix(c, "predict:")).to_column(F.col("predict"))
            elif c.startswith("target:"):
                p = parse_id_list(_strip_prefix(c, "target:")).to_column(F.col("target"))
            elif c:
                p = text_predicate(c, literal=literal_text, lower_both=lower_both)
            else:
                p = None
        except FilterSyntaxError:
            if lenient:
                continue
            raise
        if p is not None:
            preds.append(p)
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def filter_corpus(df: DataFrame, criteria: str | None, **kw) -> DataFrame:
    """Rows matching the criteria (all rows when it is empty)."""
    pred = compile_criteria(criteria, **kw)
    return df if pred is None else df.where(pred)


def mark_filtered(df: DataFrame, criteria: str | None, **kw) -> DataFrame:
    """Keep every row and add ``filtered`` = row is outside the filter.
    No filter marks nothing."""
    pred = compile_criteria(criteria, **kw)
    flag = F.lit(False) if pred is None else ~F.coalesce(pred, F.lit(False))
    return df.withColumn("filtered", flag)


def build_criteria(text: str | None = None, ref: str | None = None, ts_before: str | None = None,
                   ts_at: str | None = None, ts_after: str | None = None,
                   predict: str | None = None, target: str | None = None) -> str:
    """Fields -> criteria string, in the client's field order; empty
    fields are left out."""
    parts = []
    if text:
        parts.append(text)
    if ref:
        parts.append("ref:" + ref)
    if ts_before:
        parts.append("ts:<" + ts_before)
    if ts_at:
        parts.append("ts:" + ts_at)
    if ts_after:
        parts.append("ts:>" + ts_after)
    if predict:
        parts.append("predict:" + predict)
    if target:
        parts.append("target:" + target)
    return "&&".join(parts)


def filter_groups(groups: DataFrame, ids: str | None = None, text: str | None = None,
                  id_col: str = "group", text_col: str = "repr_text") -> DataFrame:
    """Group table filter by id list and literal, case-insensitive
    substring of the representative text."""
    out = groups
    if ids:
        pred = parse_id_list(ids).to_column(F.col(id_col))
        if pred is not None:
            out = out.where(pred)
    if text:
        out = out.where(F.lower(F.col(text_col)).contains(text.lower()))
    return out
