"""What the user has chosen: plans, alert thresholds and a mute; and the lookups they feed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.alerts import DEFAULT_THRESHOLDS
from .operators.windows import plan_ceilings


class SettingsError(ValueError):
    """A settings file that is there but can't be used; names the file."""


@dataclass(frozen=True)
class Settings:
    plans: dict[str, str] = field(default_factory=dict)
    alerts: dict[str, list[int]] = field(default_factory=dict)
    muted_until: int | None = None

    def thresholds(self, provider: str) -> list[int]:
        return list(self.alerts.get(provider, DEFAULT_THRESHOLDS))

    def muted(self, now: int) -> bool:
        return self.muted_until is not None and self.muted_until > now


def load(path: str) -> Settings:
    """The settings of a JSON file; those of no file are the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return Settings()
    except ValueError as e:
        raise SettingsError(f"invalid settings JSON in {path}: {e}") from e
    if not isinstance(found, dict):
        raise SettingsError(f"invalid settings JSON in {path}: no object")
    return Settings(found.get("plans") or {}, found.get("alerts") or {}, found.get("mutedUntil"))


def chosen_ceilings(spark: SparkSession, plans: DataFrame) -> DataFrame:
    """Ceilings of the chosen plans (provider, plan); an unknown plan has none, never a default."""
    return plan_ceilings(spark).join(F.broadcast(plans.select("provider", "plan")), ["provider", "plan"])


def thresholds(providers: DataFrame, chosen: DataFrame) -> DataFrame:
    """provider, thresholds: what was chosen, else the defaults."""
    default = F.array(*map(F.lit, DEFAULT_THRESHOLDS))
    return providers.select("provider").distinct().join(F.broadcast(chosen), "provider", "left").select("provider", F.coalesce("thresholds", default).alias("thresholds"))
