"""Signal decisions inside one bucket of passing quotes, and what it hands on.

A quote is accepted if it lies outside every stress block and at least `base` ns after
the last accepted quote.  The second rule is truly recursive, but the past acts on a
bucket only through a threshold: the first accepted quote of the bucket is the first
unblocked one at or after max(end of earlier blocks, last accepted + base), and from there
the bucket alone decides.  So a bucket is summarised by a step function from the last
accepted time before the bucket to the one after it.  Step functions compose, so groups of
buckets are reduced in parallel and only their composition is walked per symbol.

Everything here works on numpy arrays of one bucket (at most 2**bits rows).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

# Fixed values: "no signal accepted yet", and "covers every possible value".
NEVER = -(2**63)
ALWAYS = 2**63 - 1

Steps = tuple[list[int], list[int]]  # (upto, exits): values up to upto[j] lead to exits[j]


def block_ends(
    ts: np.ndarray, mid: np.ndarray, base: int, longest: int, stress: float, before: float | None
) -> np.ndarray:
    """End of the stress block in force at each quote, from the moves up to it."""
    previous = np.empty_like(mid)
    previous[1:] = mid[:-1]
    previous[:1] = np.nan if before is None else before
    move = np.abs(mid - previous) / previous * 10_000.0
    scaled = base * (1.0 + move / stress)
    sharp = move >= stress
    rest = np.where(sharp & (scaled < longest), scaled, 0.0).astype(np.int64)
    cooldown = np.where(scaled >= longest, np.int64(longest), rest)
    end = np.where(ts > ALWAYS - cooldown, ALWAYS, ts + cooldown)
    return np.maximum.accumulate(np.where(sharp, end, 0)) if len(ts) else ts


def _successors(ts: np.ndarray, base: int) -> np.ndarray:
    """Index of the first quote at least `base` after each quote (len(ts) if none)."""
    if len(ts) == 0:
        return np.zeros(0, dtype=np.int64)
    since_first = ts - ts[0]
    return np.searchsorted(since_first, since_first + base, side="left")


def _chain_ends(following: np.ndarray) -> np.ndarray:
    """Last quote of the chain of successors from each quote, by doubling the jumps."""
    own = np.arange(len(following))
    at = np.where(following < len(following), following, own)
    while True:
        far = at[at]
        if np.array_equal(far, at):
            return at
        at = far


def accepted_rows(ts: np.ndarray, base: int, threshold: int = NEVER) -> list[int]:
    """Positions accepted among unblocked quotes in order; equal times: first arrival wins."""
    at = int(np.searchsorted(ts, threshold, side="left"))
    if base == 0:
        return list(range(at, len(ts)))
    following = _successors(ts, base).tolist()
    chain = []
    while at < len(ts):
        chain.append(at)
        at = following[at]
    return chain


def moves(mid: np.ndarray, before: float | None) -> np.ndarray:
    """Move of each quote against the one before, in basis points."""
    previous = np.empty_like(mid)
    previous[1:] = mid[:-1]
    previous[:1] = np.nan if before is None else before
    return np.abs(mid - previous) / previous * 10_000.0


def open_ranges(
    ts: np.ndarray, move: np.ndarray, base: int, longest: int, stress: float, blocked_until: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranges [first, behind) of quotes outside every stress block, and the end of the last block.

    As `block_ends`, but after one comparison per quote only sharp moves and ranges are touched.
    """
    sharp = np.flatnonzero(move >= stress)
    at, scaled = ts[sharp], base * (1.0 + move[sharp] / stress)
    rest = np.where(scaled < longest, scaled, 0.0).astype(np.int64)
    cooldown = np.where(scaled >= longest, np.int64(longest), rest)
    end = np.where(at > ALWAYS - cooldown, ALWAYS, at + cooldown)
    ends = np.maximum.accumulate(np.concatenate((np.array([blocked_until], dtype=np.int64), end)))
    first, behind = np.concatenate(([0], sharp)), np.concatenate((sharp, [len(ts)]))
    some = np.flatnonzero((behind > first) & (ts[behind - 1] >= ends))
    first = np.maximum(first[some], np.searchsorted(ts, ends[some], side="left"))
    return first, behind[some], int(ends[-1])


def rows_of(first: np.ndarray, behind: np.ndarray, size: int) -> np.ndarray:
    """Positions in disjoint ranges."""
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[first] += 1
    edge[behind] -= 1
    return np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))


def accepted_in_ranges(
    ts: np.ndarray, times: list[int], first: np.ndarray, behind: np.ndarray, base: int, threshold: int
) -> np.ndarray | list[int]:
    """Positions accepted among the quotes of open ranges; `times` is `ts` as a list.

    A long quiet period leaves few signals, each found by bisection; for a short one the
    successors of all open quotes are cheaper.
    """
    if not len(first):
        return []
    if base == 0 or (times[-1] - times[0]) // base * 16 > int((behind - first).sum()):
        rows = rows_of(first, behind, len(ts))
        return rows[accepted_rows(ts[rows], base, threshold)]
    starts, stops = first.tolist(), behind.tolist()
    chain, place, at = [], 0, bisect_left(times, threshold)
    while True:
        if at >= stops[place]:
            place = bisect_right(stops, at, place + 1)
            if place == len(stops):
                return chain
        at = max(at, starts[place])
        chain.append(at)
        at = bisect_left(times, times[at] + base, at + 1)


def after_last_pause(ts: np.ndarray, base: int) -> np.ndarray:
    """Open quotes from the last one that every chain of signals passes.

    A quote at least `base` after the one before it is accepted whatever came earlier.
    """
    pauses = np.flatnonzero(np.diff(ts) >= base)
    return ts[pauses[-1] + 1 :] if len(pauses) else ts


def _merged(upto: list[int], exits: list[int]) -> Steps:
    out_upto: list[int] = []
    out_exits: list[int] = []
    for bound, value in zip(upto, exits):
        if out_exits and out_exits[-1] == value:
            out_upto[-1] = bound
        else:
            out_upto.append(bound)
            out_exits.append(value)
    return out_upto, out_exits


def threshold_steps(ts: np.ndarray, base: int, reach: int) -> Steps:
    """Last accepted time of the bucket as a function of the entry threshold.

    No threshold lies above `reach`: earlier signals and blocks are no later than the
    first quote of the bucket plus the longest quiet period.  So the function has at most
    one step per quote of that period, however many quotes the bucket holds.
    """
    entries = int(np.searchsorted(ts, reach, side="left")) + 1
    exits = ts[:entries] if base == 0 else ts[_chain_ends(_successors(ts, base))[:entries]]
    if base == 0 and len(ts):
        exits = np.full(len(exits), ts[-1])
    last = np.flatnonzero(np.append(exits[1:] != exits[:-1], True)) if len(exits) else []
    return ts[:entries][last].tolist(), exits[last].tolist()


def signal_steps(steps: Steps, base: int, blocked_until: int, first_ts: int) -> Steps:
    """The same as a function of the last accepted time before the bucket.

    Thresholds below `blocked_until` cannot occur.  No earlier signal is later than the
    first quote of the bucket, so the step that covers `first_ts` covers all the rest.
    """
    upto, exits = [], []
    for bound, value in zip(*steps):
        if bound < blocked_until:
            continue
        exits.append(value)
        if bound - base >= first_ts:
            upto.append(ALWAYS)
            break
        upto.append(bound - base)
    return _merged(upto, exits)


def apply_steps(steps: Steps, value: int) -> int:
    upto, exits = steps
    j = bisect_left(upto, value)
    return exits[j] if j < len(upto) else value


def compose_steps(first: Steps, second: Steps) -> Steps:
    """The step function of `first` followed by `second`."""
    upto = list(first[0])
    exits = [apply_steps(second, value) for value in first[1]]
    edge = upto[-1] if upto else NEVER - 1
    for bound, value in zip(*second):
        if bound > edge:
            upto.append(bound)
            exits.append(value)
    return _merged(upto, exits)


def composed(functions: list[Steps]) -> Steps:
    """All functions one after the other, composed in a tree."""
    while len(functions) > 1:
        pairs = [compose_steps(a, b) for a, b in zip(functions[::2], functions[1::2])]
        functions = pairs + functions[2 * len(pairs) :]
    return functions[0] if functions else ([], [])


def entry_threshold(last: int, base: int, blocked_until: int) -> int:
    after = NEVER if last == NEVER else min(last + base, ALWAYS)
    return max(after, blocked_until)
