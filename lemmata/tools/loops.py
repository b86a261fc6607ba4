"""Rules that never settle."""

from __future__ import annotations


class LoopError(RuntimeError):
    """Rules went on beyond the limit of cycles; ``Session.max_cycles`` sets it."""


def limited(on_limit, cycles: int, rules: list[str]) -> None:
    """What happens, once, when the limit is passed: ``raise`` ends the firing,
    ``print`` warns and lets the rules go on, and a function is called with the
    cycles and the rules that were active last, and they go on if it returns."""
    if callable(on_limit):
        on_limit(cycles, rules)
        return
    text = f"rules did not settle in {cycles} cycles: {', '.join(rules)}"
    if on_limit == "print":
        print(text)
        return
    raise LoopError(text)
