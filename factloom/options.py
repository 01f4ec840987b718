"""Descriptors of analyses and their options, resolution of configured values, and the registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

MAX_ID = 252
# Names that can't be file names everywhere.
RESERVED = {"con", "prn", "aux", "nul"} | {f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)}


class InvalidOptions(ValueError):
    """A configuration that doesn't fit the descriptors."""


def json_kind(value: Any) -> str:
    """The JSON kind of a value; booleans are no numbers."""
    if isinstance(value, bool):
        return "boolean"
    for kind, types in (("number", (int, float)), ("string", (str,)), ("array", (list, tuple)), ("object", (dict,))):
        if isinstance(value, types):
            return kind
    return "null"


@dataclass(frozen=True)
class Option:
    """A named value: its default fixes its JSON kind, valid says which values of that kind may be set."""

    name: str
    default: Any
    valid: Callable[[Any], bool] = lambda _: True
    says: str = ""

    def __post_init__(self):
        if not self.name or self.name != self.name.strip():
            raise InvalidOptions(f"option name {self.name!r} is empty or padded")
        self.check(self.default)

    def check(self, value: Any) -> Any:
        if json_kind(value) != json_kind(self.default):
            raise InvalidOptions(f"option {self.name!r} takes a {json_kind(self.default)}, not a {json_kind(value)}")
        if not self.valid(value):
            raise InvalidOptions(f"option {self.name!r} can't be {value!r}" + (f": {self.says}" if self.says else ""))
        return value


@dataclass(frozen=True)
class Descriptor:
    """What an analysis is called, asks and can be told."""

    id: str
    version: int
    questions: tuple[str, ...]
    options: tuple[Option, ...] = ()
    test_options: tuple[str, ...] = ()
    enabled: bool = True

    def __post_init__(self):
        if len(self.id) > MAX_ID or not re.fullmatch(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?", self.id) or self.id in RESERVED:
            raise InvalidOptions(f"analysis id {self.id!r} is no safe lower-case slug")
        if self.version < 1:
            raise InvalidOptions("version must be positive")
        if not self.questions or not all(q.strip() for q in self.questions):
            raise InvalidOptions("at least one question that isn't empty is needed")
        names = [o.name for o in self.options]
        if len(set(names)) < len(names):
            raise InvalidOptions("an option name is repeated")
        if len(set(self.test_options)) < len(self.test_options) or not set(self.test_options) <= set(names):
            raise InvalidOptions("test options must be declared options, each once")

    def resolve(self, configured: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Defaults under configured values, sorted by name."""
        configured = configured or {}
        known = {o.name: o for o in self.options}
        if unknown := sorted(set(configured) - set(known)):
            raise InvalidOptions(f"unknown options: {', '.join(unknown)}")
        return {n: known[n].check(configured.get(n, known[n].default)) for n in sorted(known)}

    def resolve_tests(self, general: Mapping[str, Any], configured: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Values for test projects: configured ones over the effective general ones."""
        configured = configured or {}
        known = {o.name: o for o in self.options}
        if bad := sorted(set(configured) - set(self.test_options)):
            raise InvalidOptions(f"not options for tests: {', '.join(bad)}")
        return {n: known[n].check(configured[n]) if n in configured else general[n] for n in sorted(general)}


@dataclass(frozen=True)
class Effective:
    """Resolved values by role."""

    general: dict[str, Any]
    tests: dict[str, Any]

    def of(self, role: str) -> dict[str, Any]:
        return self.tests if role == "Tests" else self.general


@dataclass
class Analysis:
    """A plug-in: a descriptor and a function from facts (named DataFrames) and options to findings."""

    descriptor: Descriptor
    run: Callable[[Mapping[str, DataFrame], Effective], DataFrame]
    present: Callable[[list], str] | None = None


@dataclass
class Registry:
    """Analyses by id, in the order of ids."""

    analyses: dict[str, Analysis] = field(default_factory=dict)

    def add(self, analysis: Analysis) -> None:
        if analysis.descriptor.id in self.analyses:
            raise InvalidOptions(f"analysis {analysis.descriptor.id!r} is registered twice")
        self.analyses[analysis.descriptor.id] = analysis

    def __iter__(self) -> Iterable[Analysis]:
        return iter(self.analyses[k] for k in sorted(self.analyses))

    def configure(self, configured: Iterable[Mapping[str, Any]]) -> list[tuple[Analysis, bool, Effective]]:
        """(analysis, enabled, options) in the order of ids; those not listed are disabled.

        Disabled ones are checked like others. An id that is unknown or listed twice is an error.
        """
        listed: dict[str, Mapping[str, Any]] = {}
        for entry in configured:
            if entry.get("id") not in self.analyses:
                raise InvalidOptions(f"unknown analysis {entry.get('id')!r}")
            if entry["id"] in listed:
                raise InvalidOptions(f"analysis {entry['id']!r} is listed twice")
            if more := set(entry) - {"id", "enabled", "options", "testOptions"}:
                raise InvalidOptions(f"unknown fields: {', '.join(sorted(more))}")
            listed[entry["id"]] = entry
        out = []
        for a in self:
            own = listed.get(a.descriptor.id, {"enabled": False})
            enabled = own.get("enabled", a.descriptor.enabled)
            if not isinstance(enabled, bool):
                raise InvalidOptions("enabled takes true or false")
            general = a.descriptor.resolve(own.get("options"))
            out.append((a, enabled, Effective(general, a.descriptor.resolve_tests(general, own.get("testOptions")))))
        return out
