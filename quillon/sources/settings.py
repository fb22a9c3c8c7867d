"""Settings files: thresholds, grants and secret rules, checked before anything uses them."""

from __future__ import annotations

import json
import re
from dataclasses import fields

from ..config import CORPORA, EngineConfig
from ..functions.text import Rule


def load_config(text: str) -> EngineConfig:
    """Settings from YAML; unknown keys, missing types and values out of range are errors."""
    import yaml

    data = yaml.safe_load(text) or {}
    known = {f.name: f for f in fields(EngineConfig)}
    if extra := sorted(set(data) - set(known)):
        raise ValueError(f"unknown settings {extra}")
    for name, value in data.items():
        default = getattr(EngineConfig(), name)
        if isinstance(value, bool) or (isinstance(default, (int, float)) and not isinstance(value, (int, float))):
            raise ValueError(f"{name} must be a number")
    return EngineConfig(**data)


def check_pin(cfg: EngineConfig, pin: str) -> None:
    if cfg.fingerprint() != pin:
        raise ValueError("the settings are not the approved ones")


def load_grants(text: str) -> dict[str, dict]:
    """Clients with the corpora and scopes they may use."""
    import yaml

    clients = (yaml.safe_load(text) or {}).get("clients", {})
    for name, c in clients.items():
        if not set(c.get("allowed_corpora", [])) <= set(CORPORA):
            raise ValueError(f"{name}: unknown corpus")
        if not set(c.get("allowed_scopes", [])) <= {*CORPORA, "both"}:
            raise ValueError(f"{name}: unknown scope")
        if "both" in c.get("allowed_scopes", []) and set(c["allowed_corpora"]) != set(CORPORA):
            raise ValueError(f"{name}: both needs all corpora")
    tokens = [c.get("token_env") for c in clients.values()]
    if len(set(tokens)) < len(tokens):
        raise ValueError("two clients share a token")
    return clients


def load_rules(text: str) -> tuple[tuple[Rule, ...], frozenset]:
    """Secret rules and allowed values from JSON; a name given twice in one object is an error."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is given twice")
        return dict(pairs)

    data = json.loads(text, object_pairs_hook=once)
    rules = []
    for p in data["patterns"]:
        if p["action"] not in ("redact", "log"):
            raise ValueError(f"{p['name']}: no action {p['action']!r}")
        if re.compile(p["regex"]).groups < p.get("capture_group", 0):
            raise ValueError(f"{p['name']}: no such group")
        rules.append(Rule(p["name"], p["regex"], p["action"], p.get("capture_group", 0), p.get("placeholder", "<REDACTED>"), p.get("min_len", 0), p.get("min_entropy", 0.0)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return tuple(rules), frozenset(v.strip(" \t\r\n").translate(lower) for v in data.get("allowlist", []))


def switch(raw: str | None) -> bool:
    """A setting that is on or off: exactly true or false, off if there is none."""
    if raw is None:
        return False
    word = raw.strip().lower()
    if word not in ("true", "false"):
        raise ValueError(f"{raw!r} is neither true nor false")
    return word == "true"


#: The settings that move the engine away from its usual places; all of them or none.
ISOLATION = ("base", "raw", "entries", "vectors", "edges", "lexical", "log", "rules")


def isolated(overrides: dict[str, str | None]) -> dict[str, str] | None:
    """Other places for all that the engine reads and writes; an error if only some are given, none if none are."""
    given = {k: v for k, v in overrides.items() if v}
    if unknown := sorted(set(given) - set(ISOLATION)):
        raise ValueError(f"unknown places {unknown}")
    if given and len(given) < len(ISOLATION):
        raise ValueError(f"places are missing: {sorted(set(ISOLATION) - set(given))}")
    return given or None
