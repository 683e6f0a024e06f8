"""Track numbers of frames that arrive as a stream: the same as those of a whole run, from a bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.number import resolve_pair

SCHEMA = "domain string, frame_id long, feature long, track long, status int, merge_track long, split_track long, reset int"
#: The last number, the frame before and the open one (id -1: none); pixels of both; for the former's objects what is known by now.
_FRAMES = "minted long, first boolean, " + ", ".join(f"{k}_id long, {k}_time long, " + ", ".join(f"{k}_{c} array<long>" for c in ("y", "x", "f")) for k in ("last", "open")) + ", " + ", ".join(f"n_{c} array<long>" for c in ("f", "track", "status", "of", "new"))


class _Frame:
    def __init__(self, frame: int, time: int, y=(), x=(), f=()):
        self.id, self.time, self.y, self.x, self.f = frame, time, list(y), list(x), list(f)

    def sizes(self) -> dict[int, int]:
        return pd.Series(self.f, dtype="int64").value_counts().to_dict()

    def fields(self) -> tuple:
        return self.id, self.time, self.y, self.x, self.f


def _links(a: _Frame, b: _Frame, least: float) -> list[tuple[str, int, int]]:
    both = pd.DataFrame({"y": a.y, "x": a.x, "ref": a.f}).merge(pd.DataFrame({"y": b.y, "x": b.x, "new": b.f}), on=["y", "x"])
    shared, of, to = both.groupby(["ref", "new"]).size(), a.sizes(), b.sizes()
    return [(way, r, n) for (r, n), k in shared.items() for way, whole in (("forward", of[r]), ("backward", to[n])) if k / whole > least]


class Numbers(StatefulProcessor):
    """Holds a domain's open frame, the frame before with its objects' numbers, and the last number."""

    def __init__(self, least: float, timegap: float):
        self.least, self.gap = least, round(timegap * 3600)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("frames", _FRAMES)

    def _load(self) -> None:
        s = self.state.get() if self.state.exists() else None
        self.minted, self.first, self.last, self.open, self.nodes = 0, True, None, None, {}
        if s is not None:
            self.minted, self.first = s[0], s[1]
            self.last, self.open = (_Frame(*s[k : k + 5]) if s[k] >= 0 else None for k in (2, 7))
            self.nodes = {f: [t, st, None if of < 0 else of, bool(new)] for f, t, st, of, new in zip(*s[12:17])}

    def _save(self) -> None:
        columns = zip(*[(f, t, st, -1 if of is None else of, int(new)) for f, (t, st, of, new) in self.nodes.items()]) if self.nodes else [[]] * 5
        frames = [v for f in (self.last, self.open) for v in (f or _Frame(-1, -1)).fields()]
        self.state.update((self.minted, self.first, *frames, *map(list, columns)))

    def _given_out(self, key: str, became: dict[int, tuple[int, int | None]], ends: bool) -> list[tuple]:
        """The rows of the frame before: its objects' numbers, and statuses now that it is known what became of them."""
        out = []
        for f, (track, status, of, new) in sorted(self.nodes.items()):
            more, into = became.get(f, (0, None))
            reset = 1 if self.first else 2 if ends else 0 if new else None
            out.append((key, self.last.id, f, track, status + more, self.nodes[into][0] if into is not None else None, of, reset))
        return out

    def _closed(self, key: str) -> list[tuple]:
        """The open frame has all its rows: it is compared with the frame before, whose rows come out, and takes its place."""
        a, b, out = self.last, self.open, []
        if a is not None and b.time - a.time < self.gap:
            if self.first:
                for f in sorted(a.sizes()):
                    self.minted += 1
                    self.nodes[f] = [self.minted, 0, None, True]
            rows = resolve_pair(_links(a, b, self.least), a.sizes(), b.sizes())
            out = self._given_out(key, {f: (s, other) for side, f, s, _, _, other in rows if side == "ref"}, False)
            nodes = {f: [self.nodes[of][0] if of is not None else self.minted + place + 1, s, self.nodes[other][0] if other is not None else None, of is None] for side, f, s, of, place, other in rows if side == "new"}
            self.minted += next(s for side, _, s, *_ in rows if side == "mints")
            self.nodes, self.first = nodes, False
        else:
            # A frame without a neighbour on either side has no numbers.
            out = self._given_out(key, {}, True) if a is not None and not self.first else []
            self.nodes, self.first = {}, True
        self.last, self.open = b, None
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out = []
        for (time, frame), own in pd.concat(list(rows)).groupby(["base_time", "frame_id"]):
            done = max([f.time for f in (self.last,) if f is not None], default=-1)
            if time <= done or self.open is not None and time < self.open.time:
                continue
            if self.open is not None and time > self.open.time:
                out += self._closed(key[0])
            if self.open is None:
                self.open = _Frame(int(frame), int(time))
                self.handle.registerTimer((int(time) + self.gap) * 1000)
            own = own.loc[own["feature"].notna(), ["y", "x", "feature"]].astype("int64")
            for held, c in ((self.open.y, "y"), (self.open.x, "x"), (self.open.f, "feature")):
                held += own[c].tolist()
        self._save()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No row within the gap after the open frame can come any more: it is the last of its segment."""
        self._load()
        out = []
        if self.open is not None and (self.open.time + self.gap) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out = self._closed(key[0])
        if self.open is None and self.last is not None and (self.last.time + self.gap) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out += self._given_out(key[0], {}, True) if not self.first else []
            # Its time stays, so that rows which come too late are known.
            self.last, self.nodes, self.first = _Frame(self.last.id, self.last.time), {}, True
        self._save()
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        types = {c.split(" ")[0]: "Int64" if c.endswith("long") else "Int32" for c in SCHEMA.split(", ")[1:]}
        return pd.DataFrame(out, columns=names).astype(types)


def numbered(labels: DataFrame, least: float, timegap: float, time: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(domain, frame_id, feature, track, status, merge_track, split_track, reset): numbers of :func:`operators.number.track_numbers`, as frames arrive.

    ``labels`` (domain, frame_id, base_time in seconds, y, x, feature, and ``time``, the same time as a timestamp) is a stream;
    each domain is numbered on its own.  A frame is complete when a row of a later one of its domain arrives, or when the
    watermark (``late``) is ``timegap`` hours past it, by a timer; its objects' rows come out when it is known what became of
    them, one frame later.  A row without a feature says that its frame has begun.  Rows of frames before the open one are late and
    dropped.  The state of a domain is two frames.  Needs the RocksDB state store.
    """
    rows = labels.withWatermark(time, late)
    return rows.groupBy("domain").transformWithStateInPandas(Numbers(least, timegap), SCHEMA, "append", "eventtime")
