"""Alert cooldowns: an alert is sent if none was sent for its key within the hours before. Greedy, so each alert depends on all before it.

No task follows a key from its first candidate to its last. Time is cut into slices that are longer than the cooldown. All that a slice needs to know
of the past is from when on alerts are allowed again, and that lies within one cooldown of its start: a few candidates are possible first alerts, and
for each the slice tells from when on alerts are allowed after it. These maps are composed, some slices at a time, to one map for each key; going back
down, every slice gets the time it starts from, and replays its own candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

SECONDS = 1 << 22  # seconds of a key that one task holds: of a slice, or of the possible first alerts of the slices that are composed
ALWAYS, NEVER = -(1 << 62), (1 << 62)


def _groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by ``names``, cut so that no group is split, with the starts of groups and the end; nulls are a group."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        starts = _starts(batch, names)
        rest = batch.slice(starts[-1])
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])  # starts and the end


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        column = batch.column(name)
        before, now = column.slice(0, len(column) - 1), column.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(before, now), False), pc.not_equal(before.is_null(), now.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name), np.int64)


def _taken(batch: pa.RecordBatch, names: list[str], at: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    at = pa.array(at)
    return pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in names], *[pa.array(v) for v in more.values()]], [*names, *more])


def _maps(keys: list[str], width: int, gap: int):
    """Map of each slice: rows (upto, after) in order; where alerts are allowed from t on, the first row with ``upto`` >= t tells from when on after the slice."""
    def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, [*keys, "_slice"]):
            at, upto, after = [], [], []
            sec, slices = _ints(batch, "sec"), _ints(batch, "_slice")
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                c = sec[a:b]
                begin = slices[a] * width
                first = int(np.searchsorted(c, begin + gap))  # candidates that may come first, and the next one after them
                after_ = np.searchsorted(c, c + gap)
                now = np.arange(min(first + 1, len(c)))
                while True:
                    then = after_[now]
                    some = then < len(c)
                    if not some.any():
                        break
                    now = np.where(some, then, now)
                out = c[now] + gap
                if first == len(c):  # none comes after a time past the last possible one: allowed from the next slice on
                    out = np.append(out, begin + gap)
                at.append(np.full(first + 1, a))
                upto.append(np.append(c[:first], NEVER))
                after.append(out)
            yield _taken(batch, [*keys, "_slice"], np.concatenate(at), upto=np.concatenate(upto), after=np.concatenate(after))
    return maps


def _through(upto: np.ndarray, after: np.ndarray, t: np.ndarray) -> np.ndarray:
    return after[np.searchsorted(upto, t)]


def _composed(keys: list[str]):
    """Maps of slices that were put together: the first one's rows, led through the others."""
    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, [*keys, "_up"]):
            at, out = [], []
            inner, upto, after = np.append(_starts(batch, [*keys, "_slice"]), batch.num_rows), _ints(batch, "upto"), _ints(batch, "after")
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = inner[(inner >= a) & (inner <= b)]
                t = after[own[0]:own[1]]
                for x, y in zip(own[1:-1], own[2:], strict=True):
                    t = _through(upto[x:y], after[x:y], t)
                at.append(np.arange(own[0], own[1]))
                out.append(t)
            at = np.concatenate(at)
            up = batch.column("_up").take(pa.array(at))
            row = _taken(batch, keys, at, upto=upto[at], after=np.concatenate(out))
            yield pa.RecordBatch.from_arrays([*[row.column(k) for k in keys], up, row.column("upto"), row.column("after")], [*keys, "_slice", "upto", "after"])
    return composed


def _handed_down(keys: list[str]):
    """The time that each slice starts from, told the time of what it was put together to."""
    def handed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, [*keys, "_up"]):
            at, out = [], []
            inner, upto, after, begin = np.append(_starts(batch, [*keys, "_slice"]), batch.num_rows), _ints(batch, "upto"), _ints(batch, "after"), _ints(batch, "from")
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = inner[(inner >= a) & (inner <= b)]
                t = begin[a:a + 1]
                for x, y in zip(own[:-1], own[1:], strict=True):
                    at.append(x)
                    out.append(t[0])
                    t = _through(upto[x:y], after[x:y], t)
            yield _taken(batch, [*keys, "_slice"], np.array(at), **{"from": np.array(out)})
    return handed


def _replayed(keys: list[str], names: list[str], gap: int):
    """The candidates of each slice that are sent."""
    def replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, [*keys, "_slice"]):
            sec, begin, keep = _ints(batch, "sec"), _ints(batch, "from"), []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                t = begin[a]
                while True:
                    a = a + int(np.searchsorted(sec[a:b], t))
                    if a >= b:
                        break
                    keep.append(a)
                    t = sec[a] + gap
            yield batch.select(names).take(pa.array(keep, pa.int64()))
    return replayed


def _sorted(df: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *more)


def cooldown(candidates: DataFrame, keys: list[str], ts: str, hours: float, payload: list[str] | None = None, seconds: int = SECONDS) -> DataFrame:
    """Alerts that pass a cooldown of ``hours`` since the last alert *sent* for the key (bound inclusive): keys, sec, ts, payload.

    Times have second resolution, so candidates are first thinned to one per key and second, the earliest and of equal ones the least payload.
    A task holds at most ``seconds`` of a key (twice the cooldown at least), however long the key is. Null keys are a key. Rows without a time are left out.
    """
    payload = payload or []
    gap = int(hours * 3600)
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    first = F.min(F.struct(F.col(ts), *[F.col(p) for p in payload])).alias("_f")
    thin = (candidates.filter(F.col(ts).isNotNull()).groupBy(*keys, sec.alias("sec")).agg(first)
            .select(*keys, "sec", *[F.col(f"_f.{c}").alias(c) for c in [ts, *payload]]))
    width, fan = max(seconds, 2 * gap, 1), max(2, seconds // max(gap, 1))
    thin = written(thin.withColumn("_slice", F.floor(F.col("sec") / width)), "cooldown-candidates")
    low, high = thin.agg(F.min("_slice"), F.max("_slice")).first()
    kinds = ", ".join(f"`{k}` {t}" for k, t in thin.dtypes if k in keys)
    levels = []
    if low is not None and high > low:
        maps = _sorted(thin.select(*keys, "_slice", "sec"), [*keys, "_slice"], ["sec"])
        levels.append(written(maps.mapInArrow(_maps(keys, width, gap), f"{kinds}, _slice bigint, upto bigint, after bigint"), "cooldown-maps"))
    base, span = low, (high - low + 1) if low is not None else 1

    def up(offset: int) -> Column:
        return F.floor((F.col("_slice") - offset) / fan)
    while span > fan:
        wide = _sorted(levels[-1].withColumn("_up", up(base)), [*keys, "_up"], ["_slice", "upto"])
        levels.append(written(wide.mapInArrow(_composed(keys), f"{kinds}, _slice bigint, upto bigint, after bigint"), "cooldown-maps"))
        base, span = 0, -(-span // fan)
    begin = None
    for i in range(len(levels) - 1, -1, -1):
        offset = low if i == 0 else 0
        if begin is None:
            told = levels[i].withColumn("_up", F.lit(0).cast("bigint")).withColumn("from", F.lit(ALWAYS))
        else:
            told = _met(levels[i].withColumn("_up", up(offset)), begin.withColumnRenamed("_slice", "_up"), [*keys, "_up"], "from")
        begin = _sorted(told, [*keys, "_up"], ["_slice", "upto"]).mapInArrow(_handed_down(keys), f"{kinds}, _slice bigint, `from` bigint")
    rows = thin.withColumn("from", F.lit(ALWAYS)) if begin is None else _met(thin, begin, [*keys, "_slice"], "from")
    names = [c for c in thin.columns if c != "_slice"]
    out = ", ".join(f"`{k}` {t}" for k, t in thin.dtypes if k != "_slice")
    return _sorted(rows, [*keys, "_slice"], ["sec"]).mapInArrow(_replayed(keys, names, gap), out)


def _met(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    side = right.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], value)
    same = F.col(on[0]).eqNullSafe(F.col("_on_0"))
    for i, c in enumerate(on[1:], 1):
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{i}"))
    return left.join(side, same).drop(*[f"_on_{i}" for i in range(len(on))])
