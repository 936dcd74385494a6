"""Rule, AML, report and cost settings as data, with JSON loaders.

Rules fall back to defaults field by field; AML and SAR files must name every
field. Loaded rules carry a version; Reloader keeps the last good ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Velocity:
    window_secs: int
    limit: int
    low_value_minor: int = 200


@dataclass(frozen=True)
class Rules:
    """Deny lists, high-risk merchant codes and the limits of the stateful rules."""

    version: str = "rules-default"
    deny_bins: tuple[str, ...] = ()
    deny_tokens: tuple[str, ...] = ()
    deny_devices: tuple[str, ...] = ()
    deny_ips: tuple[str, ...] = ()
    deny_merchants: tuple[str, ...] = ()
    deny_counterparties: tuple[str, ...] = ()
    high_risk_mcc: tuple[int, ...] = (7995, 6051, 4829, 6211)
    card_testing: Velocity = Velocity(300, 5, 200)
    bin_attack: Velocity = Velocity(300, 10)
    decline_retry: Velocity = Velocity(600, 5)
    max_kmh: float = 1000.0
    anomaly_factor: float = 10.0
    anomaly_min_samples: int = 5


# The model's feature has a list of its own, shorter than the rules' list.
MODEL_HIGH_RISK_MCC = (7995, 4829, 6051)


@dataclass(frozen=True)
class Aml:
    ctr_threshold_minor: int = 1_000_000
    structuring_band_minor: int = 100_000
    structuring_min_count: int = 3
    funnel_min_geographies: int = 3
    funnel_max_destinations: int = 2
    round_trip_tolerance: float = 0.05
    round_trip_window_secs: int = 15_552_000


@dataclass(frozen=True)
class Sar:
    filing_window_days: int = 30
    continuing_activity_days: int = 90
    ctr_threshold_minor: int = 1_000_000


@dataclass(frozen=True)
class Costs:
    """(cost if fraud, cost if legitimate) of each action, in tie-break order."""

    approve: tuple[float, float] = (100.0, 0.0)
    decline: tuple[float, float] = (0.0, 30.0)
    step_up: tuple[float, float] = (20.0, 5.0)
    review: tuple[float, float] = (8.0, 15.0)
    hold: tuple[float, float] = (5.0, 18.0)


def _read(path: str) -> dict:
    try:
        data = json.loads(Path(path).read_text())
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    except ValueError as e:
        raise ConfigError(f"cannot parse {path}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path} holds no object")
    return data


#: Rules field -> path of keys in a rules file; the layout is fixed by existing files.
RULES_FILE = {
    "version": ("version",),
    "deny_bins": ("blocklists", "bins"),
    "deny_tokens": ("blocklists", "pan_tokens"),
    "deny_devices": ("blocklists", "devices"),
    "deny_ips": ("blocklists", "ips"),
    "deny_merchants": ("blocklists", "merchants"),
    "deny_counterparties": ("blocklists", "counterparties"),
    "high_risk_mcc": ("mcc_risk", "high_risk"),
    "max_kmh": ("impossible_travel", "max_speed_kmh"),
    "anomaly_factor": ("amount_anomaly", "factor"),
    "anomaly_min_samples": ("amount_anomaly", "min_samples"),
}
VELOCITY_FILE = {
    "card_testing": ("max_low_value_auths", "low_value_threshold_minor"),
    "bin_attack": ("max_distinct_pans", None),
    "decline_retry": ("max_declines", None),
}


def load_rules(path: str) -> Rules:
    """A rules file; what it doesn't name keeps its default."""
    data, base, got = _read(path), Rules(), {}

    def find(keys):
        at = data
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return None
            at = at[k]
        return at

    for name, keys in RULES_FILE.items():
        v = find(keys)
        if v is not None:
            got[name] = tuple(v) if isinstance(v, list) else v
    for name, (limit, low) in VELOCITY_FILE.items():
        v, d = find(("velocity", name)) or {}, getattr(base, name)
        got[name] = Velocity(v.get("window_secs", d.window_secs), v.get(limit, d.limit), v.get(low, d.low_value_minor) if low else d.low_value_minor)
    return Rules(**got)


def _strict(cls, path: str):
    data = _read(path)
    missing = [f.name for f in fields(cls) if f.name not in data]
    if missing:
        raise ConfigError(f"{path} lacks {', '.join(missing)}")
    return cls(**{f.name: data[f.name] for f in fields(cls)})


def load_aml(path: str) -> Aml:
    return _strict(Aml, path)


def load_sar(path: str) -> Sar:
    return _strict(Sar, path)


@dataclass
class Reloader:
    """current() rereads the file and keeps the last good rules if that fails; for use once per micro-batch."""

    path: str
    rules: Rules = field(default_factory=Rules)
    failures: int = 0

    def current(self) -> Rules:
        try:
            self.rules = load_rules(self.path)
        except (ConfigError, TypeError):
            self.failures += 1
        return self.rules
