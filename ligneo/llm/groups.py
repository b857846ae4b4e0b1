"""Work on many small groups per Python call."""

import numpy as np
import pandas as pd

from ligneo.llm.common import forget_others


def whole_groups(frames, keys):
    """Rejoin sorted batches so that every frame that comes out holds whole groups only."""
    held = []
    for frame in frames:
        if frame.empty:
            continue
        last = np.ones(len(frame), dtype=bool)
        for key in keys:
            last &= (frame[key] == frame[key].iloc[-1]).to_numpy()
        begin = int(len(frame) - last[::-1].argmin()) if not last.all() else 0
        same = held and all(held[-1][key].iloc[-1] == frame[key].iloc[0] for key in keys)
        if last.all() and (same or not held):
            held.append(frame)
            continue
        done = [*held, frame.iloc[:begin]]
        yield pd.concat(done, ignore_index=True)
        held = [frame.iloc[begin:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame, keys):
    """Starts and ends of the runs of equal keys."""
    change = np.zeros(len(frame), dtype=bool)
    change[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(frame))


def sorted_groups(df, keys, work, schema, partitions, order=()):
    """Apply `work(frame of whole groups)` to rows brought together by `keys` and sorted by them, then by `order`.

    For groups of bounded size: rows of one key meet in one task.
    """
    def run(frames):
        forget_others()
        for frame in whole_groups(frames, keys):
            yield work(frame)

    return df.repartition(partitions, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def local_roots(count, a, b):
    """For nodes 0..count-1 linked by pairs (a, b): the least node each can reach."""
    root = np.arange(count)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low
