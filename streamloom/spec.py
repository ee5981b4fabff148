"""Stream definitions: what a stream reads, how it is parsed and where it goes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

#: Trigger codes of sources (10 to 17 poll, 20 to 22 wait) and store target codes.
POLLS = {10: "soap", 11: "socket", 12: "http", 13: "watch", 14: "sql", 15: "class", 16: "file", 17: "table"}
WAITS = {20: "soap", 21: "socket", 22: "http"}
UNITS_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
HOST, LOG_ID = "COLLECT_HOSTNAME", "COLLECT_LOG_ID"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    data_type: str = "VARCHAR"
    src: str | None = None
    order: int = 0


@dataclass(frozen=True)
class DistinctRule:
    """Duplicates by ``fields`` within tumbling windows of ``unit`` x ``count``, apart by ``part_field``."""

    fields: tuple[str, ...]
    unit: str
    count: int
    part_field: str | None = None
    time_field: str | None = None
    expected: int = 10_000
    check_range: int = 1

    @property
    def window_ms(self) -> int:
        return UNITS_MS[self.unit] * self.count

    @classmethod
    def parse(cls, rule: str | dict | None) -> DistinctRule | None:
        """Keys ``fields`` and ``timeRange`` (``d:1``, ``h:2``, ``m:30``) are required; null or empty: no rule."""
        if not rule:
            return None
        found = json.loads(rule) if isinstance(rule, str) else rule
        names = tuple(x.strip() for x in str(found.get("fields") or "").split(",") if x.strip())
        unit, _, count = str(found.get("timeRange") or "").partition(":")
        if not names or unit.lower() not in UNITS_MS or not count.isdigit() or int(count) < 1:
            raise ValueError(f"a distinct rule needs fields and a timeRange like d:1: {found}")
        return cls(names, unit.lower(), int(count), found.get("partField") or None, found.get("timeField") or None, int(found.get("predictNum") or 10_000), int(found.get("checkRange") or 1))


def parse_config(text: str | None) -> dict[str, str]:
    """``key=value`` lines; lines that start with # are remarks and ``\\n`` stands for a line end."""
    out = {}
    for line in (text or "").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            out[key.strip()] = value.strip().replace("\\n", "\n")
    return out


@dataclass(frozen=True)
class StoreSpec:
    store_id: int
    target: str = "text"
    filter_rule: str | None = None
    distinct: DistinctRule | None = None
    config: tuple[tuple[str, str], ...] = ()
    threads: int = 3
    log_level: int = 0
    plugin: str | None = None
    state: int = 1

    @property
    def options(self) -> dict[str, str]:
        return dict(self.config)


@dataclass(frozen=True)
class StreamSpec:
    msg_id: int
    name: str
    fields: tuple[FieldSpec, ...]
    trigger: int = 16
    url: str = ""
    user: str = ""
    password: str = ""
    params: tuple[tuple[str, str], ...] = ()
    scheme: str = ""
    content: str = "text"
    split: str = ","
    ordered: bool = False
    cache_ds: int = 0
    stores: tuple[StoreSpec, ...] = ()

    def __post_init__(self):
        names = [f.name.upper() for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"field names repeat in {self.name}")

    @property
    def positions(self) -> dict[str, int]:
        """Index of each column, envelope first."""
        return {n: i for i, n in enumerate([HOST, LOG_ID, *(f.name for f in self.fields)])}

    @property
    def passive(self) -> bool:
        return self.trigger >= 20

    @classmethod
    def from_json(cls, text: str | dict) -> StreamSpec:
        raw = json.loads(text) if isinstance(text, str) else dict(text)
        own = {f.name for f in fields(cls)}
        made = {k: v for k, v in raw.items() if k in own}
        made["fields"] = tuple(sorted((FieldSpec(**f) for f in raw["fields"]), key=lambda f: f.order))
        made["params"] = tuple(sorted((raw.get("params") or {}).items()))
        stores = []
        for s in raw.get("stores", []):
            rule, conf = DistinctRule.parse(s.get("distinct")), s.get("config") or {}
            conf = parse_config(conf) if isinstance(conf, str) else conf
            stores.append(StoreSpec(**s | {"distinct": rule, "config": tuple(sorted(conf.items()))}))
        return cls(**made | {"stores": tuple(stores)})


def needs_restart(old: StreamSpec, new: StreamSpec) -> bool:
    """Whether a changed definition must start anew.

    A filter rule, plugin, log level or scheme alone takes effect without; anything that changes the
    source, the parsing, the stores' targets or their duplicates does not.
    """
    look = lambda s: (s.trigger, s.name, s.params, s.url, s.user, s.password, s.ordered, s.cache_ds)
    shape = lambda s: [(f.name, f.data_type, f.src) for f in s.fields]
    out = lambda s: {x.store_id: (x.target, x.threads, x.distinct, x.config) for x in s.stores}
    return look(old) != look(new) or shape(old) != shape(new) or out(old) != out(new)
