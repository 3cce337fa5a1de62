"""Settings of an experiment: declared once, read strictly."""

from __future__ import annotations

from typing import Any

# fixed values: the settings an experiment file may name, their types and defaults
SETTINGS: dict[str, tuple[type, Any]] = {
    "name": (str, "baseline"), "base_model": (str, "google/mt5-base"), "model_revision": (str, "main"),
    "pivot": (str, None), "pivot_data": (str, None), "pivot_size": (int, 50_000), "pivot_epochs": (float, 1.0), "pivot_lr": (float, 5e-4),
    "target_epochs": (float, 20.0), "target_lr": (float, 3e-4), "use_lexicon": (bool, False),
    "batch_size": (int, 16), "grad_accum": (int, 2), "max_source_len": (int, 128), "max_target_len": (int, 128), "bf16": (bool, True),
    "seed": (int, 13), "pivot_seed": (int, 13), "target_seed": (int, None), "early_stopping_patience": (int, 3), "smoke": (bool, False),
}
STAGE_B = {"name", "target_epochs", "target_lr", "use_lexicon", "target_seed", "early_stopping_patience"}


def settings(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All settings with ``given`` put in; unknown names and wrong types raise."""
    given = given or {}
    if unknown := sorted(set(given) - set(SETTINGS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {k: default for k, (_, default) in SETTINGS.items()}
    for k, v in given.items():
        kind = SETTINGS[k][0]
        if v is not None and kind is float and isinstance(v, (int, str)) and not isinstance(v, bool):
            v = float(v)
        if v is not None and not isinstance(v, kind):
            raise ValueError(f"{k} should be {kind.__name__}, is {v!r}")
        out[k] = v
    return out


def load_settings(path: str) -> dict[str, Any]:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f))


def pivot_path(s: dict[str, Any], root: str) -> str:
    """The pivot table that the settings name, or the one of its key and size."""
    return f"{root}/{s['pivot_data']}" if s["pivot_data"] else f"{root}/pivot/{s['pivot']}_{s['pivot_size']}"


def first_stage(s: dict[str, Any]) -> dict[str, Any]:
    """The settings on which the first stage of training depends; its cache key is made of them."""
    return {k: v for k, v in s.items() if k not in STAGE_B}
