"""Out-of-band messages: counts and samples that a query reports while it runs, without a pass of their own."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation

log = logging.getLogger("lamina")


def observed(df: DataFrame, **messages: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the messages, aggregates by name, once an action over df has run."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in messages.items())), seen


def report(seen: Observation, prefix: str = "message") -> dict:
    """Logs what was observed and returns it."""
    found = seen.get
    for name, value in found.items():
        log.info("%s %s: %s", prefix, name, value)
    return found
