"""Fields that pack a list into one string, split into one row per entry with its position.

The kernel works on the character buffers of Arrow string columns as arrays of bytes: quote parity and
delimiter masks give the child offsets of all lists of a batch at once, from which a list array is built
and flattened with the ordinals of its parents. There is no loop over rows or entries. Batches are cut
to a bounded number of bytes, so that a partition of long texts needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries per list of each sensor; the two averaged fields exist for the last two only.
SPECTRUM_SIZE = {"PARSIVEL": 1024, "PARSIVEL2": 1024, "LPM": 440, "ODM470": 128, "RD80": 20}
AVERAGED_SIZE = {"PARSIVEL": 32, "PARSIVEL2": 32}
#: An entry of this value means that the class saw no drop.
NO_DROP = -9.999
#: Bytes of text that one step of the kernel works on.
STEP_BYTES = 500_000

_OTHER, _DIGIT, _HARD, _BLANK, _QUOTE, _COMMA, _DOT, _SIGN = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[ord("0") : ord("9") + 1] = _DIGIT
    for chars, kind in ((";|\t", _HARD), (" \r\n", _BLANK), ("\"'", _QUOTE), (",", _COMMA), (".", _DOT), ("+-", _SIGN)):
        for c in chars:
            table[ord(c)] = kind
    return table


_CLASS = _classes()


def _split(data: np.ndarray, kind: np.ndarray, owner: np.ndarray, n_lists: int, decimal_comma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all lists under one reading of the comma.

    ``data``, ``kind`` and ``owner`` (the list of each byte) hold no quotes any more. Returns start and
    end of each entry in ``data``, its list, and the number of entries per list.
    """
    kind = np.where((kind == _COMMA) & ~decimal_comma, _HARD, kind)
    size = len(data)
    at = np.arange(size)
    blank = kind == _BLANK
    solid = ~blank
    # The nearest byte before and after that is no blank, if of the same list.
    before = np.maximum.accumulate(np.where(solid, at, -1)) if size else at
    after = np.minimum.accumulate(np.where(solid, at, size)[::-1])[::-1] if size else at
    has_before = (before >= 0) & (owner[np.maximum(before, 0)] == owner)
    has_after = (after < size) & (owner[np.minimum(after, size - 1)] == owner) if size else has_before
    hard = kind == _HARD
    beside_hard = (has_before & hard[np.maximum(before, 0)]) | (has_after & hard[np.minimum(after, max(size - 1, 0))]) if size else hard
    first_of_run = blank & np.concatenate(([True], solid[:-1] | (owner[1:] != owner[:-1])))[:size] if size else blank
    separator = hard | (first_of_run & has_before & has_after & ~beside_hard)
    # One separator at either end encloses the list and is no entry.
    ends_list = hard & (~_prior(has_before, owner, at) | ~_later(has_after, owner, at, size))
    cut = separator & ~ends_list
    content = ~(separator | blank)
    # Entries: a list with any content or inner separator has one more entry than inner separators.
    cuts = np.bincount(owner[cut], minlength=n_lists)
    filled = np.bincount(owner[content], minlength=n_lists) > 0
    counts = np.where(filled | (cuts > 0), cuts + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    # The entry of each content byte: entries of the lists before, plus the cuts before it in its list.
    cuts_before = np.cumsum(cut)
    list_cuts_before = np.concatenate(([0], np.cumsum(cuts)))
    where = np.flatnonzero(content)
    entry = first[owner[where]] + cuts_before[where] - list_cuts_before[owner[where]]
    total = int(first[-1])
    start, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    if len(where):
        lead = np.concatenate(([True], entry[1:] != entry[:-1]))
        last = np.concatenate((entry[1:] != entry[:-1], [True]))
        start[entry[lead]] = where[lead]
        end[entry[last]] = where[last] + 1
    return start, end, np.repeat(np.arange(n_lists), counts), counts


def _prior(has_before: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a byte other than a blank stands before this one in its list."""
    if not len(at):
        return has_before
    # has_before of a solid byte is about itself; look one byte back.
    back = np.concatenate(([False], has_before[:-1] & (owner[:-1] == owner[1:])))
    return back


def _later(has_after: np.ndarray, owner: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    if not size:
        return has_after
    return np.concatenate((has_after[1:] & (owner[1:] == owner[:-1]), [False]))


def parse_lists(texts: pa.Array, sizes: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """A list array of float64, one list per text, and which texts are whole lists.

    A text is whole if it has as many entries as ``sizes`` says and each is a number or empty (0). Of
    the two readings of the comma, separator or decimal mark between digits, the one that gives the
    right number counts. A text that is null, broken or of unknown size (below 1) is a null list.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if n == 0:
        return pa.array([], pa.list_(pa.float64())), np.zeros(0, bool)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    present = ~np.asarray(texts.is_null())
    owner = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data]
    quote = kind == _QUOTE
    # Quote parity: a comma inside the quotes of a single entry is a decimal mark. Quotes around the
    # whole list are one pair and say nothing about its commas.
    if quote.any():
        n_quotes = np.bincount(owner[quote], minlength=n)
        running = np.cumsum(quote)
        start_of = np.concatenate(([0], np.cumsum(n_quotes)))[:-1]
        inside = ((running - start_of[owner]) % 2 == 1) & (n_quotes[owner] > 2)
    else:
        inside = np.zeros(len(data), bool)
    digit = kind == _DIGIT
    same_left = np.concatenate(([False], owner[1:] == owner[:-1]))[: len(data)]
    same_right = np.concatenate((owner[1:] == owner[:-1], [False]))[: len(data)]
    left = np.concatenate(([False], digit[:-1]))[: len(data)] & same_left
    right = np.concatenate((digit[1:], [False]))[: len(data)] & same_right
    between = (kind == _COMMA) & left & right
    keep = ~quote
    data, kind, owner, between, inside = data[keep], kind[keep], owner[keep], between[keep], (inside & (kind == _COMMA))[keep]

    sizes = np.asarray(sizes, np.int64)
    values, parents, whole = [], [], np.zeros(n, bool)
    open_ = present & (sizes > 0)
    for comma, possible in ((inside, np.ones(n, bool)), (between, np.bincount(owner[between], minlength=n) > 0)):
        # The second reading is only tried on lists that the first does not fit and that have such commas.
        tried = open_ & possible
        if not tried.any():
            continue
        part = tried[owner]
        bytes_, kinds, commas = (data, kind, comma) if part.all() else (data[part], kind[part], comma[part])
        start, end, of, counts = _split(bytes_, kinds, owner if part.all() else owner[part], n, commas)
        fit = tried & (counts == sizes)
        open_ = open_ & ~fit
        chosen = fit[of]
        v, valid = _numbers(bytes_, kinds, start[chosen], end[chosen], commas)
        parent = of[chosen]
        good = fit & (np.bincount(parent[~valid], minlength=n) == 0)
        whole |= good
        take = good[parent]
        values.append(v[take])
        parents.append(parent[take])
    if not parents:
        return pa.array([None] * n, pa.list_(pa.float64())), whole
    parent = np.concatenate(parents)
    order = np.argsort(parent, kind="stable")
    flat = np.concatenate(values)[order]
    list_offsets = np.concatenate(([0], np.cumsum(np.where(whole, sizes, 0)))).astype(np.int32)
    # A null offset makes its list null; the last offset is never null.
    mask = np.concatenate((~whole, [False]))
    return pa.ListArray.from_arrays(pa.array(list_offsets, mask=mask), pa.array(flat)), whole


def _numbers(data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, comma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and validity of each entry; an empty entry is a valid 0."""
    values = np.zeros(len(start))
    if not len(start):
        return values, np.ones(0, bool)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[end] - total[start]

    digits, marks = within(kind == _DIGIT), within((kind == _DOT) | comma)
    signs = within(kind == _SIGN)
    others = within((kind == _OTHER) | (kind == _BLANK))
    empty = end == start
    signed = ~empty & (kind[np.minimum(start, len(kind) - 1)] == _SIGN) if len(kind) else empty
    plain = (digits > 0) & (marks <= 1) & (others == 0) & (signs == signed)
    valid = plain | empty
    odd = np.flatnonzero(~valid)
    nonzero = plain & (within((kind == _DIGIT) & (data != ord("0"))) > 0)
    need = np.flatnonzero(nonzero)
    clean = np.where(comma, np.uint8(ord(".")), data)
    if len(need):
        begin = start[need] + (data[start[need]] == ord("+"))
        values[need] = pc.cast(_children(clean, begin, end[need]), pa.float64()).to_numpy(zero_copy_only=False)
    if len(odd):  # rare: exponents, and what is no number at all
        texts = _children(clean, start[odd], end[odd])
        good = pc.match_substring_regex(texts, r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$").to_numpy(zero_copy_only=False)
        valid[odd[good]] = True
        if good.any():
            values[odd[good]] = pc.cast(pc.utf8_ltrim(texts.filter(pa.array(good)), "+"), pa.float64()).to_numpy(zero_copy_only=False)
    return values, valid


def _children(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string array of the given spans."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])])


def list_column(text: Column, size: int, order: Sequence[int] | None = None) -> Column:
    """A packed text as an array of ``size`` doubles in the given order of positions; null for a broken list."""
    positions = None if order is None else np.asarray(order, np.int64)

    @F.arrow_udf("array<double>")
    def parse(texts: pa.Array) -> pa.Array:
        parts = []
        step = max(1, STEP_BYTES // max(1, size * 2))
        for a in range(0, len(texts), step):
            lists, whole = parse_lists(texts.slice(a, step), np.full(min(step, len(texts) - a), size))
            if positions is not None and whole.any():
                values = lists.flatten().to_numpy().reshape(-1, size)[:, positions]
                offsets = np.concatenate(([0], np.cumsum(np.where(whole, size, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate((~whole, [False]))), pa.array(values.ravel()))
            parts.append(lists)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return parse(text)


def entries(telegrams: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("raw_drop_number", "raw_drop_concentration", "raw_drop_average_velocity"), drops_only: bool = False) -> DataFrame:
    """One row per entry: telegram_id, field_name, pos (from 0), value.

    A list that is null, of the wrong length for the station's sensor, or with an entry that is no
    number gives no rows; neither does a station without sensor. ``drops_only`` leaves out entries of 0
    and NO_DROP before they leave the kernel. Repeated telegrams each give their entries. Extra columns
    are dropped.
    """
    sensors = sources.select("station_id", "sensor_name").dropDuplicates(["station_id"])

    def size(of: dict[str, int]):
        out = F.lit(0)
        for sensor, n in of.items():
            out = F.when(F.upper(F.trim("sensor_name")) == sensor, F.lit(n)).otherwise(out)
        return out.cast("int")

    joined = telegrams.select("telegram_id", "station_id", *fields).join(sensors, "station_id")
    sized = joined.select("telegram_id", *fields, *[size(SPECTRUM_SIZE if f == "raw_drop_number" else AVERAGED_SIZE).alias(f"n_{f}") for f in fields])
    schema = pa.schema([("telegram_id", pa.int64()), ("field_name", pa.string()), ("pos", pa.int32()), ("value", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, fields):
                for f in fields:
                    lists, whole = parse_lists(piece.column(piece.schema.get_field_index(f)), piece.column(piece.schema.get_field_index(f"n_{f}")).to_numpy(zero_copy_only=False))
                    if not whole.any():
                        continue
                    parent = pc.list_parent_indices(lists).to_numpy()
                    value = lists.flatten().to_numpy()
                    first = np.concatenate(([True], parent[1:] != parent[:-1]))
                    pos = np.arange(len(parent)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                    ids = piece.column(0).to_numpy(zero_copy_only=False)[parent]
                    if drops_only:
                        keep = (value != 0) & (value != NO_DROP)
                        ids, pos, value = ids[keep], pos[keep], value[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f], pa.string()).take(pa.array(np.zeros(len(ids), np.int32))), pa.array(pos, pa.int32()), pa.array(value)], schema=schema)

    return sized.where(F.col("telegram_id").isNotNull()).mapInArrow(kernel, "telegram_id bigint, field_name string, pos int, value double")


def _pieces(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most STEP_BYTES of text, or a single row."""
    size = sum(np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(f))).to_numpy(zero_copy_only=False).astype(float)) for f in fields)
    step = np.floor_divide(np.cumsum(size), STEP_BYTES) if len(size) else size
    cuts = np.flatnonzero(np.diff(step)) + 1 if len(size) else []
    bounds = [0, *map(int, cuts), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
