"""Which way a query can run over a stream, decided before it starts.

Stateless steps run on each row; grouped steps hold state for each key; what needs the end of the input (last position, reverse, sorting the
whole) runs in batches; what is ordered without a key is refused.
"""

from __future__ import annotations

from enum import Enum


class AnalysisError(ValueError):
    """The query cannot run over a stream."""


class Plan(Enum):
    STATELESS = "stateless"
    KEYED_STATE = "keyed-state"
    BATCH = "batch"


STATELESS = frozenset("filter project for-each simple-map choose rules copy value-of motionless-predicate".split())
AGGREGATES = frozenset("count sum avg min max string-join head sequence exists group-by fork".split())
ORDERED = frozenset("accumulator iterate group-adjacent group-starting-with group-ending-with position head-of-group".split())
WHOLE_INPUT = frozenset("last reverse sort perform-sort key distinct-values merge".split())


def classify(steps: list[str], keyed: bool) -> Plan:
    """The plan of a chain of steps; the most demanding step decides.  Ordered steps without a key, and unknown steps, raise."""
    known = STATELESS | AGGREGATES | ORDERED | WHOLE_INPUT
    if unknown := [s for s in steps if s not in known]:
        raise AnalysisError(f"unknown steps: {unknown}")
    if not keyed and (free := [s for s in steps if s in ORDERED]):
        raise AnalysisError(f"a stream has no order across keys; give a key for {free}")
    if any(s in WHOLE_INPUT for s in steps):
        return Plan.BATCH
    if any(s in AGGREGATES | ORDERED for s in steps):
        return Plan.KEYED_STATE
    return Plan.STATELESS


def streamable(steps: list[str], keyed: bool) -> bool:
    """Whether the chain runs with bounded memory: no step waits for the end of the input."""
    try:
        return classify(steps, keyed) is not Plan.BATCH
    except AnalysisError:
        return False
