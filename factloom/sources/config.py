"""Strict JSON configuration of a run and the choice of a solution file."""

from __future__ import annotations

import json
from pathlib import Path, PurePosixPath

from ..options import InvalidOptions, Registry

# The fields of the format.
FIELDS = {"schemaVersion", "solution", "outputDirectory", "analyses"}


def _once(pairs: list[tuple]) -> dict:
    out = {}
    for k, v in pairs:
        if k in out:
            raise InvalidOptions(f"field {k!r} comes twice")
        out[k] = v
    return out


def parse(text: str, registry: Registry) -> dict:
    """The configuration, its analyses resolved: no comments, no field twice at any depth, exact fields."""
    try:
        config = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as e:
        raise InvalidOptions(f"not JSON: {e}") from e
    if not isinstance(config, dict) or set(config) != FIELDS:
        raise InvalidOptions(f"fields must be {', '.join(sorted(FIELDS))}")
    if config["schemaVersion"] != 1 or isinstance(config["schemaVersion"], bool):
        raise InvalidOptions("schemaVersion must be 1")
    if not isinstance(config["analyses"], list) or not all(isinstance(a, dict) for a in config["analyses"]):
        raise InvalidOptions("analyses must be a list of objects")
    for name in ("solution", "outputDirectory"):
        p = config[name]
        if not isinstance(p, str) or not p or PurePosixPath(p).is_absolute() or ".." in PurePosixPath(p).parts:
            raise InvalidOptions(f"{name} must be a path below the project root")
    return config | {"analyses": registry.configure(config["analyses"])}


def default(solution: str, registry: Registry, output: str = "reports") -> str:
    """A configuration with every analysis, its defaults, and test options where there are any."""
    analyses = []
    for a in registry:
        values = a.descriptor.resolve()
        entry: dict = {"id": a.descriptor.id, "enabled": a.descriptor.enabled, "options": values}
        if a.descriptor.test_options:
            entry["testOptions"] = {n: values[n] for n in sorted(a.descriptor.test_options)}
        analyses.append(entry)
    return json.dumps({"schemaVersion": 1, "solution": solution, "outputDirectory": output, "analyses": analyses}, indent=2) + "\n"


def discover_solution(folder: str | Path) -> Path:
    """The first solution file of a folder: named like it first, .slnx before .sln, then by name."""
    folder = Path(folder)
    found = [p for p in folder.iterdir() if p.suffix.lower() in (".sln", ".slnx")]
    if not found:
        raise InvalidOptions(f"no solution file in {folder}")
    return min(found, key=lambda p: (p.stem.lower() != folder.resolve().name.lower(), p.suffix.lower() != ".slnx", p.name))
