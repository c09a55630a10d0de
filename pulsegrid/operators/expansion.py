"""Trips of whole segments as chains of occurrences, for the tasks of ``timetable``: Spark deals the segments, numpy follows all chains of a batch at once.

Each minute of a row is an occurrence, and where its train goes on it names one
occurrence of the next row: the first that is late enough.  A trip is the chain
from an occurrence of a departure row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of segments that are linked at once (a segment is never cut), and events that leave in one batch (a trip is never cut).
ROWS, EVENTS = 16_384, 262_144


class Linked:
    """The occurrences of some segments' rows: ``row`` and ``at`` (minute) of each, and ``following``, the one it leads to, or -1."""

    def __init__(self, lengths: np.ndarray, rows: pa.StructArray, bounds: tuple[int, int, int, tuple[int, int], int]):
        day_start, departure_end, arrival_end, (first, last), dwell_most = bounds
        get = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        n = len(rows)
        self.segment = np.repeat(np.arange(len(lengths)), lengths)
        self.station, self.kind, self.seq = rows.field("station"), rows.field("kind"), rows.field("seq")
        names = self.station.dictionary_encode()
        self.code, self.codes = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(names.dictionary)
        self.ab, self.an = (pc.equal(self.kind, k).to_numpy(zero_copy_only=False) for k in ("ab", "an"))
        minute, odd, p, q = get("minute").astype(np.int64), get("odd").astype(np.int64), get("p"), get("q")

        def shifted(x: np.ndarray, k: int, none: object) -> np.ndarray:
            """``x`` of the row ``k`` rows on in the same segment."""
            i = np.arange(n) + k
            inside = (i >= 0) & (i < n)
            i = np.clip(i, 0, max(n - 1, 0))
            return np.where(inside & (self.segment[i] == self.segment), x[i], none)

        alike = lambda a, b: (a >= 0) & (a == b)  # noqa: E731  a station without a name is like no other
        back = shifted(self.code, -2, -1), shifted(self.code, -1, -1)
        turn = shifted(self.ab, -2, False) & shifted(self.an, -1, False) & self.ab & shifted(self.an, 1, False) & alike(back[1], self.code) & alike(back[0], shifted(self.code, 1, -1))
        #: A row and the next one are the two ends of a dwell.
        self.stays = self.an & shifted(self.ab, 1, False) & alike(self.code, shifted(self.code, 1, -1))

        hours = np.arange(first, last + 1)
        t = minute[:, None] + 60 * hours
        ok = ((odd < 0)[:, None] | (hours % 2 == odd[:, None])) & (t >= day_start) & np.where(self.ab[:, None], t < departure_end, t <= arrival_end)
        number = np.where(ok, np.cumsum(ok).reshape(ok.shape) - 1, -1)
        self.row, at_hour = np.nonzero(ok)
        self.at = t[self.row, at_hour]
        to = np.minimum(self.row + 1, n - 1)
        dwell = self.stays[self.row]
        least = np.where(dwell, self.at, self.at + 1)
        least = np.where(p[to], np.maximum(least, (self.at // 60 + 1) * 60), least)
        least = np.where(q[to], np.maximum(least, self.at + 60), least)
        hour = np.maximum(-((minute[to] - least) // 60), first)
        hour += (odd[to] >= 0) & (hour % 2 != odd[to])
        goes = shifted(np.ones(n, bool), 1, False)[self.row] & (hour <= last)
        goes &= ~(dwell & (turn[to] | (hour * 60 + minute[to] - self.at > dwell_most)))
        self.following = np.where(goes, number[to, np.minimum(hour, last) - first], -1)

    def steps(self, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The chains from ``start``, one step at a time: which of them go on, from where, and to where."""
        chain, here = np.arange(len(start)), start
        while len(chain):
            to = self.following[here]
            on = to >= 0
            chain, here, to = chain[on], here[on], to[on]
            if len(chain):
                yield chain, here, to
            here = to

    def trips(self, until: int | None) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence and number of events of each trip: a chain from a departure, before ``until`` if given, to an arrival."""
        begins = self.ab[self.row] if until is None else self.ab[self.row] & (self.at < until)
        start = np.flatnonzero(begins)
        size, end = np.ones(len(start), np.int64), start.copy()
        for chain, _, to in self.steps(start):
            size[chain] += 1
            end[chain] = to
        whole = (size > 1) & self.an[self.row[end]]
        return start[whole], size[whole]

    def events(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of the chains, one chain after the other, and where each begins."""
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(offsets[-1], np.int64)
        out[offsets[:-1]] = start
        for k, (chain, _, to) in enumerate(self.steps(start), 1):
            out[offsets[chain] + k] = to
        return out, offsets


def _batches(batches: Iterator[pa.RecordBatch], bounds) -> Iterator[tuple[pa.RecordBatch, Linked]]:
    """The segments (``segment``, ``rows``, …), some at a time, with their occurrences."""
    for batch in batches:
        sizes = np.diff(batch.column("rows").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), ROWS, "right")))
            part = batch.slice(low, high - low)
            if sizes[low:high].sum():
                yield part, Linked(sizes[low:high], part.column("rows").flatten(), bounds)
            else:
                yield part, None
            low = high


def expanded(bounds, until: int | None):
    """For ``mapInArrow``: a row for each trip."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, linked in _batches(batches, bounds):
            if linked is None:
                continue
            start, size = linked.trips(until)
            upto, low = np.cumsum(size), 0
            while low < len(start):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + EVENTS, "right")))
                here = start[low:high]
                on, offsets = linked.events(here, size[low:high])
                rows = pa.array(linked.row[on])
                events = pa.StructArray.from_arrays([linked.station.take(rows), linked.kind.take(rows), pa.array(linked.at[on].astype(np.int32))], ["station", "kind", "minute"])
                first = linked.row[here]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(linked.segment[first])), linked.seq.take(pa.array(first)), pa.array(linked.at[here].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), events)],
                    ["segment", "start_seq", "start", "events"],
                )
                low = high

    return made


def shaped(bounds):
    """For ``mapInArrow``: a row for each segment with the number of its trips, their shapes and extreme dwells; columns but ``rows`` pass."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, linked in _batches(batches, bounds):
            keep = [i for i, name in enumerate(part.schema.names) if name != "rows"]
            n, low, high, shapes = _shapes(part.num_rows, linked)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], n, low, high, shapes], [*[part.schema.names[i] for i in keep], "n", "low", "high", "shapes"])

    return made


def _shapes(segments: int, linked: Linked | None) -> tuple[pa.Array, ...]:
    kind = pa.struct([("shape", pa.string()), ("n", pa.int64())])
    if linked is None:
        return pa.array(np.zeros(segments, np.int64)), pa.nulls(segments, pa.int32()), pa.nulls(segments, pa.int32()), pa.nulls(segments, pa.list_(kind))
    start, size = linked.trips(None)
    of = linked.segment[linked.row[start]]
    most = 1 << 30
    low, high = np.full(segments, most), np.full(segments, -1)
    # Trips are told apart step by step: by segment and first event, then by what they were before and the next event; of one that ends, the number stays.
    event = (linked.code + 1) * 2 + linked.ab
    events = 2 * linked.codes + 2
    _, same = np.unique(of * events + event[linked.row[start]], return_inverse=True)
    known = same.max(initial=-1) + 1
    for chain, here, to in linked.steps(start):
        a, b = linked.row[here], linked.row[to]
        took = linked.at[to] - linked.at[here]
        runs = linked.ab[a] & linked.an[b]
        _, now = np.unique((same[chain] * events + event[b]) * 2048 + np.where(runs, took + 1, 0), return_inverse=True)
        same[chain] = now + known
        known += now.max(initial=-1) + 1
        stays = linked.stays[a]
        np.minimum.at(low, of[chain[stays]], took[stays])
        np.maximum.at(high, of[chain[stays]], took[stays])
    _, one, times = np.unique(same, return_index=True, return_counts=True)
    order = np.argsort(of[one], kind="stable")
    one, times = one[order], times[order]
    # One trip of each shape is written out.
    on, offsets = linked.events(start[one], size[one])
    stops = pc.binary_join_element_wise(linked.station, linked.kind, ":", null_handling="skip").take(pa.array(linked.row[on]))
    inner = np.ones(len(on), bool)
    inner[offsets[1:] - 1] = False
    runs = np.flatnonzero(inner)
    runs = runs[linked.ab[linked.row[on[runs]]] & linked.an[linked.row[on[runs + 1]]]]
    minutes = pc.cast(pa.array(linked.at[on[runs + 1]] - linked.at[on[runs]]), pa.string())
    text = pc.binary_join_element_wise(
        pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), stops), "|"),
        pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(runs, offsets).astype(np.int32)), minutes), ","), "#",
    )
    per = np.bincount(of[one], minlength=segments)
    none = np.bincount(of, minlength=segments) == 0
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    shapes = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([text, pa.array(times.astype(np.int64))], ["shape", "n"]), mask=pa.array(none))
    given = lambda x: pa.array(x.astype(np.int32), mask=high < 0)
    return pa.array(np.bincount(of, minlength=segments).astype(np.int64)), given(low), given(high), shapes
