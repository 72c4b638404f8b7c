"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs


def texts(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, for a URI or an absolute path in the shared folder."""
    return fs.FileSystem.from_uri(path)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables that hold only complete groups, from batches sorted by ``keys``; about ``rows`` rows or one group each."""
    pending: list[pa.RecordBatch] = []
    held = 0

    def last_group_start(table: pa.Table) -> int:
        end = table.num_rows
        low, high = 0, end - 1
        last = [table[k][end - 1].as_py() for k in keys]
        while low < high:  # the rows are sorted: the last group is a suffix
            middle = (low + high) // 2
            if [table[k][middle].as_py() for k in keys] == last:
                high = middle
            else:
                low = middle + 1
        return low

    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.Table.from_batches(pending).combine_chunks()
        cut = last_group_start(table)
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        pending, held = rest.to_batches(), 0 if cut else -rest.num_rows  # wait for as many again if one group fills the table
        held += rest.num_rows if cut else 0
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks()
