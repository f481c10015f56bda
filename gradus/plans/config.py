"""Checks of configurations, before anything expensive runs."""

from __future__ import annotations

import math


class ConfigError(ValueError):
    pass


def _number(config: dict, name: str, low: float, high: float = math.inf, whole: bool = False) -> float:
    value = config.get(name)
    kinds = int if whole else (int, float)
    if isinstance(value, bool) or not isinstance(value, kinds) or not math.isfinite(value) or not low <= value <= high:
        raise ConfigError(f"{name} must be a {'whole ' if whole else ''}number from {low} to {high}")
    return value


def closed(config: dict, required: set[str], optional: frozenset[str] = frozenset()) -> None:
    """All required keys, and none but those and the optional ones."""
    if missing := sorted(required - config.keys()):
        raise ConfigError(f"missing: {', '.join(missing)}")
    if unknown := sorted(config.keys() - required - optional):
        raise ConfigError(f"unknown: {', '.join(unknown)}")


def check_reward(config: dict) -> None:
    closed(config, {"answer_utility", "rho_answer", "rho_visual", "format_penalty"})
    for name in ("answer_utility", "rho_answer", "rho_visual"):
        if _number(config, name, 0) == 0:
            raise ConfigError(f"{name} must be above 0")
    _number(config, "format_penalty", 0)
    if config["answer_utility"] < config["rho_answer"]:
        raise ConfigError("answer_utility must be at least rho_answer")


def check_batches(config: dict) -> None:
    """A group's completions fill whole micro batches over all ranks."""
    for name in ("group_size", "world_size", "micro_batch", "accumulation"):
        _number(config, name, 1, whole=True)
    if config["world_size"] * config["micro_batch"] * config["accumulation"] % config["group_size"]:
        raise ConfigError("world_size * micro_batch * accumulation must be a multiple of group_size")


def check_proxy(config: dict) -> None:
    _number(config, "alpha", 0, 1)
    _number(config, "baseline_weight", 0)
    if _number(config, "temperature", 0) == 0:
        raise ConfigError("temperature must be above 0")
    _number(config, "min_tokens", 1, whole=True)


def check_tracking(config: dict) -> None:
    closed(config, {"project", "run", "every"}, frozenset({"tags"}))
    for name in ("project", "run"):
        if not isinstance(config[name], str) or not config[name].strip():
            raise ConfigError(f"{name} must be text")
    _number(config, "every", 1, whole=True)
    tags = config.get("tags", [])
    if not isinstance(tags, list) or not all(isinstance(t, str) and t for t in tags) or len(set(tags)) != len(tags):
        raise ConfigError("tags must be distinct texts")
