"""Configuration files: nested values with references to other values and to the environment, resolved at once."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

_REFERENCE = re.compile(r"\$\{([^${}]+)\}")


def load(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """A JSON file, or a YAML one where a parser is there, with every reference resolved."""
    text = Path(expand(path)).read_text()
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise NotImplementedError("no YAML parser is installed; write the configuration as JSON") from e
        return resolve(yaml.safe_load(text) or {}, env)
    return resolve(json.loads(text), env)


def resolve(values: dict[str, Any], env: dict[str, str] | None = None) -> dict[str, Any]:
    """``${a.b}`` is the value of key b in a; ``${oc.env:NAME}`` and ``${oc.env:NAME,default}`` are of the environment.

    A value that is one reference keeps the kind of what it refers to. Unknown names and circles are errors.
    """
    env = dict(os.environ) if env is None else env

    def look_up(name: str, under: tuple[str, ...]) -> Any:
        if name.startswith("oc.env:"):
            key, comma, default = name.removeprefix("oc.env:").partition(",")
            if key.strip() in env:
                return env[key.strip()]
            if comma:
                return default.strip()
            raise KeyError(f"the environment has no {key.strip()}")
        if name in under:
            raise ValueError(f"{name} refers to itself")
        found: Any = values
        for part in name.split("."):
            if not isinstance(found, dict) or part not in found:
                raise KeyError(f"no value is named {name}")
            found = found[part]
        return settle(found, (*under, name))

    def settle(value: Any, under: tuple[str, ...] = ()) -> Any:
        if isinstance(value, dict):
            return {k: settle(v, under) for k, v in value.items()}
        if isinstance(value, list):
            return [settle(v, under) for v in value]
        while isinstance(value, str) and (m := _REFERENCE.search(value)):
            found = look_up(m[1].strip(), under)
            if m[0] == value:
                return found
            value = f"{value[: m.start()]}{found}{value[m.end() :]}"
        return value

    return settle(values)


def expand(path: str) -> str:
    """``~`` and variables as an absolute path."""
    return os.path.abspath(os.path.expanduser(os.path.expandvars(path)))
