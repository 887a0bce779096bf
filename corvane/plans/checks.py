"""Checks and option parsing on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def missing_parts(text: str, required: Sequence[str]) -> list[str]:
    """Required parts that an instruction lacks."""
    return [x for x in required if x not in (text or "")]


def optional_text(x: str | None) -> str | None:
    """Options write nothing as "" or "null"."""
    return None if x is None or x.strip().lower() in ("", "null") else x.strip()


def parse_ids(x: str | None) -> list[int] | None:
    x = optional_text(x)
    return None if x is None else [int(p) for p in x.split(",") if p.strip()]


def preflight(config: Mapping[str, object], tasks: Sequence[str], required: Sequence[str] = ("task", "input_path", "output_dir")) -> list[str]:
    """Problems of a configuration, without values, so that no secret is shown."""
    found = [f"{k} is missing" for k in required if config.get(k) in (None, "")]
    if config.get("task") and config["task"] not in tasks:
        found.append("task is unknown")
    found += [f"{k} is a placeholder" for k, v in config.items() if isinstance(v, str) and v.startswith("<") and v.endswith(">")]
    found += [f"{k} holds a secret; name an environment variable instead" for k, v in config.items() if "key" in k.lower() and isinstance(v, str) and v and not v.startswith("env:")]
    return found
