"""Reading sorted Arrow batches as whole groups of (station_id, day)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_starts(table: pa.Table) -> np.ndarray:
    """First row of each group; station_id and day are the first two columns."""
    day = table.column(1).to_numpy()
    codes = table.column(0).combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], (day[1:] != day[:-1]) | (codes[1:] != codes[:-1]))))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by station_id and day.

    A table holds about one batch; only a group larger than a batch is gathered beyond that, and a
    group is one source's day.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = int(group_starts(pa.Table.from_batches([batch]))[-1])
        goes_on = rest and batch.column(0)[0] == rest[-1].column(0)[-1] and batch.column(1)[0] == rest[-1].column(1)[-1]
        if last == 0:
            if rest and not goes_on:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch)
        else:
            rest.append(batch.slice(0, last))
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)
