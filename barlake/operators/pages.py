"""Results in pages: a cursor of partition and key instead of an offset."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barlake.functions.columns import all_of, any_of
from barlake.functions.filters import compile_filters, implied_by_date
from barlake.sources.files import footers, stored_files
from barlake.sources.scan import in_partitions, read_stored, selected_folders
from barlake.sources.scratch import kept
from barlake.tables import Store, Table

# Partitions that one step of a page reads at most; with filters that let few rows through, the next
# step takes twice as many.
FIRST_STEP, MOST_AT_ONCE = 8, 1_000


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: tuple | None  # where the next page begins after; None if there is none
    partitions_read: int


def page(store: Store, name: str, size: int, version: str = "v1", *, after: Sequence | None = None,
         filters: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None) -> Page:
    """The next `size` rows in order of partition and key, after the `cursor` of the page before.

    Partitions before the cursor are not read, and of those behind it only as many as the page
    needs by the row counts in their footers; more where filters leave too few rows. A step keeps
    its first rows in each task and never sorts the rest. Rows that agree in partition and key are
    told apart by all their columns; of rows equal in all the cursor counts how many were shown. So
    pages together are the whole result.

    Only the rows of the page, which the caller asked for, come to the driver, and the partitions
    of a step.
    """
    if size < 1:
        raise ValueError("A page has a row at least")
    table = store.table(name, version)
    wanted = dict(filters or {})
    predicates, _ = compile_filters(table.columns, wanted)
    predicates += implied_by_date(table, wanted)
    order = _order(table)
    files = stored_files(store, table, selected_folders(store, table, wanted))
    on_partitions, _ = compile_filters(table.partition_types, {f: v for f, v in wanted.items() if f in table.partitions})
    files = files.where(all_of(on_partitions)) if on_partitions else files
    *start, shown = after if after is not None else (None,)
    if start and table.partitions:
        files = files.where(_not_before(table.partitions, start[:len(table.partitions)]))

    def rows_of(places: Sequence[Row]) -> DataFrame:
        rows = read_stored(store, table)
        rows = rows.where(in_partitions(table.partitions, places)) if table.partitions else rows
        return rows.where(all_of(predicates)) if predicates else rows

    found: list[Row] = []
    if start:  # the rest of the rows equal to the last one
        equal = rows_of([Row(*start[:len(table.partitions)])]).where(_equal(order, start)).count()
        found = [Row(*order)(*start)] * min(size, max(0, equal - shown))
    read, step = 0, FIRST_STEP
    for places in _steps(store, table, files, lambda: (step, size - len(found))) if len(found) < size else ():
        rows = rows_of(places).where(_after(order, start)) if start else rows_of(places)
        read += len(places)
        found += rows.select(*order).orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size - len(found)).collect()
        step = min(2 * step, MOST_AT_ONCE)
        if len(found) >= size:
            break
    names = list(columns) if columns else [c for c in table.stored_schema.names if c not in table.derived]
    cursor = None
    if len(found) >= size:
        last = tuple(found[-1])
        again = sum(tuple(r) == last for r in found)
        cursor = (*last, again + (shown if start and last == tuple(start) else 0))
    return Page([Row(*names)(*[r[c] for c in names]) for r in found], cursor, read)


def _order(table: Table) -> list[str]:
    """Partition, key, then all other columns."""
    return list(dict.fromkeys((*table.identity, *table.stored_schema.names)))


def _steps(store: Store, table: Table, files: DataFrame, state: Callable[[], tuple[int, int]]) -> Iterator[list[Row]]:
    """Lists of partitions to read next, in order: as many as their rows fill the page, at most `step`."""
    if not table.partitions:
        yield []
        return
    counted = kept(footers(files).join(files, "path").groupBy(*table.partitions).agg(F.sum("rows").alias("rows")))
    pending, rows = [], 0
    for place in counted.orderBy(*[F.col(p).asc_nulls_first() for p in table.partitions]).toLocalIterator():
        pending.append(Row(*[place[p] for p in table.partitions]))
        rows += place["rows"] or 0
        step, lacking = state()
        if rows >= lacking or len(pending) >= step:
            yield pending
            pending, rows = [], 0
    if pending:
        yield pending


def _not_before(columns: Sequence[str], values: Sequence) -> Column:
    """(columns) >= (values) in order, nulls first."""
    return _after(columns, values) | _equal(columns, values)


def _equal(columns: Sequence[str], values: Sequence) -> Column:
    return all_of([F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values)])


def _after(columns: Sequence[str], values: Sequence) -> Column:
    """(columns) > (values) in order, nulls first."""
    either, same = [], []
    for c, v in zip(columns, values):
        greater = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
        either.append(all_of([*same, F.coalesce(greater, F.lit(False))]))
        same.append(F.col(c).eqNullSafe(F.lit(v)))
    return any_of(either)
