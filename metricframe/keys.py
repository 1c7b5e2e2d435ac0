"""``attr``, ``msr`` and ``rel``: references that a model's verbs resolve."""

from __future__ import annotations

from collections.abc import Iterator

from metricframe.expressions import AttrRef, Expression, MsrRef, RelRef, Spread


class _Accessor:
    def __init__(self, kind: str) -> None:
        self._kind = kind

    def __getattr__(self, key: str) -> Expression:
        if key.startswith("__") and key.endswith("__"):
            raise AttributeError(key)
        return self[key]

    def __getitem__(self, key: str) -> Expression:
        return AttrRef(key) if self._kind == "attr" else MsrRef(key)

    def __iter__(self) -> Iterator[Expression]:
        yield Spread(self._kind)


class RelationKey:
    """``rel.name``: its properties are the relation's attributes."""

    def __init__(self, identifier: str) -> None:
        self.identifier = identifier

    def __getattr__(self, key: str) -> Expression:
        if key.startswith("__") and key.endswith("__"):
            raise AttributeError(key)
        return RelRef(self.identifier, key)

    def __getitem__(self, key: str) -> Expression:
        return RelRef(self.identifier, key)

    def __iter__(self) -> Iterator[Expression]:
        yield Spread("rel", self.identifier)

    def __repr__(self) -> str:
        return f"rel.{self.identifier}"


class _Relations:
    def __getattr__(self, key: str) -> RelationKey:
        if key.startswith("__") and key.endswith("__"):
            raise AttributeError(key)
        return RelationKey(key)

    __getitem__ = __getattr__


attr, msr, rel = _Accessor("attr"), _Accessor("msr"), _Relations()
