"""Detector registry and engine."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from faultline.operators import context, history

#: fixed value: the share of one detector among 26
SHARE = 0.038462


@dataclass(frozen=True)
class Detector:
    """A detector as SQL over the window context.

    ``steps`` are named intermediate expressions, evaluated in order; ``enough`` says when there
    is enough history. Without it the record is reported benign with confidence 0.
    """

    name: str
    detected: str
    confidence: str
    kind: str
    needs: tuple[str, ...] = ()
    steps: dict[str, str] = field(default_factory=dict)
    features: tuple[str, ...] = ()
    enough: str = "true"
    weight: float = SHARE


DETECTORS: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    DETECTORS[detector.name] = detector
    return detector


def detect(df: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ("function_id",),
           limit: int = history.HISTORY, block: int = history.BLOCK, strict: bool = False) -> DataFrame:
    """Run detectors; adds one struct column per detector, in name order.

    ``strict`` suppresses the two detections whose label the record vocabulary lacks
    (``billing_abuse`` raised by the frequency and the economic detector), as a strict
    vocabulary would.
    """
    chosen = [DETECTORS[n] for n in sorted(names or DETECTORS)]
    inputs = df.columns
    out = context.build(df, {n for d in chosen for n in d.needs}, keys, limit, block, _used(chosen))
    for level in _levels(chosen):
        out = out.withColumns({name: F.expr(sql) for name, sql in level.items()})
    verdicts = []
    for d in chosen:
        found = F.expr(f"coalesce(({d.enough}) AND ({d.detected}), false)")
        sure = F.expr(f"CASE WHEN {d.enough} THEN coalesce(CAST({d.confidence} AS DOUBLE), 0D) ELSE 0D END")
        kind = F.expr(f"CASE WHEN {d.enough} THEN {d.kind} ELSE 'benign' END")
        if strict and d.name in ("frequency_anomaly", "economic_abuse"):
            odd = found & (kind == "billing_abuse")
            found, sure, kind = found & ~odd, F.when(odd, 0.0).otherwise(sure), F.when(odd, "benign").otherwise(kind)
        feats = F.map_from_arrays(
            F.array(*[F.lit(x) for x in d.features]), F.array(*[F.expr(f"CAST({x} AS DOUBLE)") for x in d.features])
        ) if d.features else F.expr("CAST(map() AS map<string, double>)")
        verdicts.append(F.struct(
            F.lit(d.name).alias("name"), found.alias("detected"), sure.alias("confidence"),
            kind.alias("anomaly_type"), sure.alias("severity"), feats.alias("features")).alias(d.name))
    return out.select(*inputs, *verdicts)


def _used(chosen: list[Detector]) -> dict[str, set[str]]:
    """The fields that the detectors' expressions read of each struct of the context."""
    used: dict[str, set[str]] = {}
    for d in chosen:
        for sql in (*d.steps.values(), d.detected, d.confidence, d.kind, d.enough, *d.features):
            for struct, name in re.findall(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)", sql):
                used.setdefault(struct, set()).add(name)
    return used


def _levels(chosen: list[Detector]) -> list[dict[str, str]]:
    """Steps of all detectors grouped so that each level only refers to earlier ones.

    A few wide projections plan and compile far faster than one projection per step.
    """
    steps = {name: sql for d in chosen for name, sql in d.steps.items()}
    depth: dict[str, int] = {}
    for d in chosen:
        for name, sql in d.steps.items():
            used = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql)) & d.steps.keys() - {name}
            depth[name] = 1 + max((depth[u] for u in used), default=0)
    return [{n: steps[n] for n in steps if depth[n] == k} for k in range(1, max(depth.values(), default=0) + 1)]


def detect_long(df: DataFrame, names: Sequence[str] | None = None, id_col: str = "event_id", **kw) -> DataFrame:
    """One row per record and detector."""
    chosen = sorted(names or DETECTORS)
    wide = detect(df, chosen, **kw)
    return wide.select(id_col, F.inline(F.array(*chosen)))
