"""Checks by name, and the place to add further ones.

A check is a function ``(source: Side, target: Side, **options) -> ScalarCheck | list[ScalarCheck]``. Its
metrics join the one aggregate per side that all scalar checks of a table share, in the batch audit as
well as in the incremental one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from evenkeel.operators import aggregates, constraints, datetimes, strings, volume
from evenkeel.operators.facts import ScalarCheck, Side

CheckPlan = Callable[..., "ScalarCheck | list[ScalarCheck]"]

CHECKS: dict[str, CheckPlan] = {
    "volume": volume.plan_volume,
    "aggregate": aggregates.plan_aggregate,
    "numeric_precision": aggregates.plan_precision,
    "null_sentinel": constraints.plan_null_sentinel,
    "constraint": lambda source, target, **options: constraints.plan_constraints(target, **options),
    "allowed_values": lambda source, target, **options: constraints.plan_allowed_values(target, **options),
    "whitespace": strings.plan_whitespace,
    "encoding": strings.plan_encoding,
    "boolean": strings.plan_boolean,
    "datetime": datetimes.plan_datetime,
}


def register(name: str) -> Callable[[CheckPlan], CheckPlan]:
    """Decorator that adds a check under a name that ``custom_checks`` of a table can use."""

    def add(plan: CheckPlan) -> CheckPlan:
        if name in CHECKS:
            raise ValueError(f"a check named '{name}' exists")
        CHECKS[name] = plan
        return plan

    return add


def plan_custom(source: Side, target: Side, spec: Mapping[str, Any]) -> list[ScalarCheck]:
    """The checks of one entry ``{"check": name, **options}``."""
    options = {k: v for k, v in spec.items() if k != "check"}
    if spec["check"] not in CHECKS:
        raise ValueError(f"no check is named '{spec['check']}'")
    planned = CHECKS[spec["check"]](source, target, **options)
    return planned if isinstance(planned, list) else [planned]
