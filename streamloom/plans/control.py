"""Control plane as pure functions: which host runs which stream."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def assign(tasks: Iterable[tuple[str, int]], hosts: Iterable[str], now: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """Streams (id, trigger) to hosts: triggers above 20 run on every host, others on one.

    A stream stays where it runs if that host lives; otherwise it goes to the host with the fewest,
    the first by name among equals. Streams that are gone leave.
    """
    out: dict[str, list[str]] = {h: [] for h in sorted(hosts)}
    if not out:
        return {}
    held = {t: h for h, ts in (now or {}).items() for t in ts if h in out}
    moving = []
    for task, trigger in tasks:
        if trigger > 20:
            for own in out.values():
                own.append(task)
        elif task in held:
            out[held[task]].append(task)
        else:
            moving.append(task)
    for task in moving:
        out[min(out, key=lambda h: (len(out[h]), h))].append(task)
    return out


def changes(old: Mapping[str, Iterable[str]], new: Mapping[str, Iterable[str]]) -> dict[str, tuple[set[str], set[str]]]:
    """What each host stops and starts."""
    return {h: (set(old.get(h, ())) - set(new.get(h, ())), set(new.get(h, ())) - set(old.get(h, ()))) for h in {*old, *new}}
