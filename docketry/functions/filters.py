"""The two filter families, each compiled to one predicate Column.

ExactFilter goes with a search: every listed value must hold, exactly.
RecordFilter tests a record on its own: any value of a list may hold, most of them as
a substring without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filed_between(start: str | None, end: str | None) -> Column:
    """Inclusive on ISO strings; a blank filing date is never inside."""
    date = F.col("filing_date")
    conditions = [date != ""]
    if start:
        conditions.append(date >= start)
    if end:
        conditions.append(date <= end)
    return all_of(conditions)


@dataclass(frozen=True)
class ExactFilter:
    technology_field: str | None = None
    assignees: Sequence[str] = ()
    inventors: Sequence[str] = ()
    countries: Sequence[str] = ()
    date_range: tuple[str | None, str | None] | None = None
    classification_codes: Sequence[str] = ()
    status: Sequence[str] = ()

    def to_column(self) -> Column:
        conditions = []
        if self.technology_field:
            conditions.append(F.col("technology_field") == self.technology_field)
        for name in ("assignees", "inventors", "classification_codes"):
            conditions += [F.array_contains(name, v) for v in getattr(self, name) or ()]
        conditions += [F.col("country") == v for v in self.countries or ()]
        conditions += [F.col("status") == v for v in self.status or ()]
        if self.date_range and any(self.date_range):
            conditions.append(filed_between(*self.date_range))
        return all_of(conditions)


def _holds(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def in_technology_field(name: str) -> Column:
    return _holds(F.col("technology_field"), name)


def has_assignee(name: str) -> Column:
    return F.exists("assignees", lambda x: _holds(x, name))


def has_inventor(name: str) -> Column:
    return F.exists("inventors", lambda x: _holds(x, name))


def has_code(part: str) -> Column:
    return F.exists("classification_codes", lambda x: F.contains(x, F.lit(part)))


def filed_after(date: str) -> Column:
    return filed_between(date, None)


def filed_before(date: str) -> Column:
    return filed_between(None, date)


@dataclass(frozen=True)
class RecordFilter:
    technology_fields: Sequence[str] = ()
    assignees: Sequence[str] = ()
    inventors: Sequence[str] = ()
    countries: Sequence[str] = ()
    date_range: tuple[str | None, str | None] | None = None
    classification_codes: Sequence[str] = ()
    status: Sequence[str] = ()
    # Carried for the search that uses this filter; no record has a score by itself.
    min_score: float = field(default=0.0)

    def is_empty(self) -> bool:
        lists = (
            self.technology_fields, self.assignees, self.inventors, self.countries,
            self.date_range, self.classification_codes, self.status,
        )
        return not any(lists) and self.min_score == 0.0

    def to_column(self) -> Column:
        tests: list[tuple[Sequence[str], Callable[[str], Column]]] = [
            (self.technology_fields, in_technology_field),
            (self.assignees, has_assignee),
            (self.inventors, has_inventor),
            (self.classification_codes, has_code),
        ]
        conditions = [any_of([test(v) for v in values]) for values, test in tests if values]
        if self.countries:
            conditions.append(F.col("country").isin(*self.countries))
        if self.status:
            conditions.append(F.col("status").isin(*self.status))
        if self.date_range and any(self.date_range):
            conditions.append(filed_between(*self.date_range))
        return all_of(conditions)
