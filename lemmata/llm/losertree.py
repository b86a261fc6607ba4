"""Front-coded sorted runs of byte strings, and their merge by a loser tree
that knows common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` bytes are known."""
    lo, hi, step = known, min(len(a), len(b)), 16
    while lo < hi:
        at = min(lo + step, hi)
        if a[lo:at] == b[lo:at]:
            lo, step = at, step * 2
        elif at - lo == 1:
            return lo
        else:  # the first difference lies before ``at``
            hi, step = at, (at - lo) // 2
            if step * 2 == at - lo and a[lo : lo + step] == b[lo : lo + step]:
                lo += step
    return lo


def front_coded(keys: Iterable[bytes]) -> bytes:
    """Sorted keys, each as (bytes shared with the one before, rest)."""
    out, last = [], b""
    for k in keys:
        n = common(last, k)
        out.append(struct.pack("<HH", n, len(k) - n))
        out.append(k[n:])
        last = k
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, bytes shared with the one before)."""
    at, last, end = 0, b"", len(run)
    while at < end:
        n, m = struct.unpack_from("<HH", run, at)
        last = last[:n] + run[at + 4 : at + 4 + m]
        yield last, n
        at += 4 + m


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, bytes shared with the key before, run) in the order of the keys;
    equal keys come in the order of their runs.

    Every contender carries how much it shares with the last winner. Of two,
    the one that shares more is the smaller; only if both share the same are
    bytes looked at, and only those after the shared ones."""
    k = max(1, len(runs))
    keys: list[bytes | None] = [None] * k
    shares = [0] * k
    sources = [iter(r) for r in runs]

    def pull(i: int) -> None:
        keys[i], shares[i] = next(sources[i], (None, 0))

    def beats(i: int, j: int) -> bool:
        """Whether i wins; the loser's share becomes that with the winner."""
        a, b = keys[i], keys[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        x, y = shares[i], shares[j]
        if x != y:
            return x > y
        n = common(a, b, x)
        first = i < j if n == len(a) == len(b) else a[n : n + 1] < b[n : n + 1]
        shares[j if first else i] = n
        return first

    for i in range(len(runs)):
        pull(i)
    # losers[1:] are inner nodes, leaf i hangs below node (k + i) // 2
    losers = [-1] * k
    winner = list(range(-k, k))
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        i, j = winner[2 * node], winner[2 * node + 1]
        if not beats(i, j):
            i, j = j, i
        winner[node], losers[node] = i, j
    best = winner[1] if k > 1 else 0
    while keys[best] is not None:
        yield keys[best], shares[best], best
        pull(best)
        node = (k + best) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2
