"""Session and plug-in settings (survey rows N1-N3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults and limits of a session.
DEFAULTS = {"autoInject": True, "tokenBudget": 6000, "reuseContext": True, "maxImplementationFiles": 2, "semanticDepth": 2, "target": None, "include": [], "exclude": []}
LIMITS = {"tokenBudget": (1000, None), "maxImplementationFiles": (1, 5), "semanticDepth": (1, 3)}


def resolve_settings(state: dict | None = None, config: dict | None = None) -> dict:
    """One session's settings: its own, else the configured, else the default ones; injection is on unless switched off."""
    given = {k: v for k, v in {**(config or {}), **(state or {})}.items() if k in DEFAULTS and v is not None}
    return {**DEFAULTS, **given, "autoInject": given.get("autoInject") is not False, "reuseContext": given.get("reuseContext") is not False}


def update_settings(state: dict, patch: dict) -> dict:
    """Settings with a patch; raises on what is unknown or out of range; fingerprints of earlier results are dropped."""
    for key, value in patch.items():
        if key not in DEFAULTS:
            raise ValueError(f"unknown setting: {key}")
        low, high = LIMITS.get(key, (None, None))
        if low is not None and (not isinstance(value, int) or isinstance(value, bool) or value < low or (high is not None and value > high)):
            raise ValueError(f"{key} is out of range: {value}")
        if key in ("include", "exclude") and (not isinstance(value, list) or any(not isinstance(x, str) or not x for x in value)):
            raise ValueError(f"{key} must be a list of ids")
    return {k: v for k, v in {**state, **patch}.items() if k not in ("fingerprint", "reusableFingerprint")}


def settings_table(sessions: DataFrame) -> DataFrame:
    """N1 over a table of sessions: ``session`` and any settings columns; nulls take the defaults, numbers are held in range."""
    out = [F.col("session")]
    for key in ("tokenBudget", "maxImplementationFiles", "semanticDepth"):
        low, high = LIMITS[key]
        value = F.coalesce(F.col(key), F.lit(DEFAULTS[key])) if key in sessions.columns else F.lit(DEFAULTS[key])
        value = F.greatest(value, F.lit(low))
        out.append((F.least(value, F.lit(high)) if high else value).alias(key))
    for key in ("autoInject", "reuseContext"):
        out.append((F.coalesce(F.col(key), F.lit(True)) if key in sessions.columns else F.lit(True)).alias(key))
    return sessions.select(*out)


def validate_config(config: dict) -> list[str]:
    """What is wrong with a plug-in configuration."""
    wrong = []
    for key in ("tokenBudget", "requestTokenBudget", "outputReserve"):
        if key in config and (not isinstance(config[key], int) or config[key] < 1):
            wrong.append(f"{key} must be a positive integer")
    if "safetyRatio" in config and not (isinstance(config["safetyRatio"], (int, float)) and config["safetyRatio"] >= 1):
        wrong.append("safetyRatio must be 1 or more")
    if config.get("outputReserve", 0) >= config.get("requestTokenBudget", 1 << 62):
        wrong.append("outputReserve must be below requestTokenBudget")
    return wrong
