"""Named templates with tunnel parameters, attribute sets, and packages with visibility and versions.

They decide what a query is made of before it runs; what they make are columns and DataFrames.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

_TUNNEL: contextvars.ContextVar[dict] = contextvars.ContextVar("tunnel", default={})


@dataclass
class Templates:
    """Named templates: functions that make a DataFrame or a column."""

    named: dict[str, Callable] = field(default_factory=dict)

    def template(self, name: str) -> Callable:
        def keep(f: Callable) -> Callable:
            self.named[name] = f
            return f

        return keep

    def call(self, name: str, *args, tunnel: dict | None = None, **params):
        """call-template: tunnel parameters reach every template called from within, at any depth, without being passed on."""
        held = _TUNNEL.set({**_TUNNEL.get(), **(tunnel or {})})
        try:
            return self.named[name](*args, **params)
        finally:
            _TUNNEL.reset(held)


def tunnel(name: str, default=None):
    """The value of a tunnel parameter inside a template."""
    return _TUNNEL.get().get(name, default)


def use_when(test: bool, then: Callable, otherwise: Callable | None = None):
    """use-when: a part that exists only if a static condition holds, decided when the query is built."""
    return then() if test else otherwise() if otherwise else None


def attribute_set(*sets: dict[str, Column], **own: Column) -> dict[str, Column]:
    """The attributes of the sets used, in order, then its own; the last of a name wins."""
    out: dict[str, Column] = {}
    for s in (*sets, own):
        for k, v in s.items():
            out.pop(k, None)
            out[k] = v
    return out


class PackageError(ValueError):
    """A package cannot be used as asked."""


@dataclass
class Package:
    """Components with visibility: public (may be used and overridden), final (used only), private (neither), abstract (must be overridden)."""

    name: str
    version: str = "1"
    components: dict[str, tuple[str, Callable | None]] = field(default_factory=dict)

    def define(self, name: str, f: Callable | None, visibility: str = "private") -> Package:
        if visibility not in ("public", "final", "private", "abstract") or (f is None) != (visibility == "abstract"):
            raise PackageError(f"{name}: visibility {visibility}")
        self.components[name] = (visibility, f)
        return self

    def use(self, other: Package, versions: str = "*", overrides: dict[str, Callable] | None = None, hide: tuple[str, ...] = ()) -> Package:
        """This package with what another exposes; hidden components become private, abstract ones must be overridden."""
        if not matches_version(other.version, versions):
            raise PackageError(f"{other.name} {other.version} is not {versions}")
        overrides = overrides or {}
        for name in overrides:
            kind = other.components.get(name, ("missing", None))[0]
            if kind not in ("public", "abstract"):
                raise PackageError(f"{name} is {kind}: it cannot be overridden")
        for name, (kind, f) in other.components.items():
            if kind == "private":
                continue
            if kind == "abstract" and name not in overrides:
                raise PackageError(f"{name} is abstract")
            self.components.setdefault(name, ("private" if name in hide else "public" if name in overrides else kind, overrides.get(name, f)))
        return self

    def call(self, name: str, *args):
        kind, f = self.components.get(name, ("missing", None))
        if kind not in ("public", "final"):
            raise PackageError(f"{name} is {kind}")
        return f(*args)


def _numbers(version: str) -> tuple[int, ...]:
    return tuple(int(p) for p in version.split("."))


def matches_version(version: str, wanted: str) -> bool:
    """Whether a version is in a list of ranges: ``*``, ``1.2``, ``1.*``, ``1.0+``, ``1.0 to 2.1``, ``to 2``, separated by commas."""
    own = _numbers(version)

    def one(r: str) -> bool:
        if r == "*":
            return True
        if " to " in f" {r} ".replace("  ", " "):
            low, _, high = f" {r} ".partition(" to ")
            return (not low.strip() or own >= _numbers(low.strip())) and (not high.strip() or own <= _numbers(high.strip()) or own[: len(_numbers(high.strip()))] == _numbers(high.strip()))
        if r.endswith(".*"):
            start = _numbers(r[:-2])
            return own[: len(start)] == start
        return own >= _numbers(r[:-1]) if r.endswith("+") else own == _numbers(r)

    return any(one(r.strip()) for r in wanted.split(","))
