"""Models and expressions as JSON and back, and a hash of that."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import fields, is_dataclass
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from metricframe import expressions as ex
from metricframe.functions.intervals import timeinterval
from metricframe.plans import nodes

if TYPE_CHECKING:
    from metricframe.model import Model
    from metricframe.sources import Connection

VERSION = 1


def _classes() -> dict[str, type]:
    from metricframe import model

    found = [c for m in (ex, nodes) for c in vars(m).values() if isinstance(c, type) and is_dataclass(c)]
    return {c.__name__: c for c in [*found, model.ActivitySchema, model.Relation, timeinterval]}


def to_wire(value: Any) -> Any:
    from metricframe.model import Model

    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, Model):
        return {"$": "Model", "value": model_to_wire(value)}
    if isinstance(value, list | tuple):
        return {"$": "tuple", "items": [to_wire(x) for x in value]}
    if isinstance(value, dict):
        return {"$": "dict", "items": [[k, to_wire(v)] for k, v in value.items()]}
    if isinstance(value, dt.datetime):
        return {"$": "datetime", "value": value.isoformat()}
    if isinstance(value, dt.date):
        return {"$": "date", "value": value.isoformat()}
    if isinstance(value, dt.timedelta):
        return {"$": "timedelta", "value": [value.days, value.seconds, value.microseconds]}
    if isinstance(value, Decimal):
        return {"$": "decimal", "value": str(value)}
    if isinstance(value, bytes):
        return {"$": "bytes", "value": value.hex()}
    if is_dataclass(value):
        return {"$": type(value).__name__} | {f.name: to_wire(getattr(value, f.name)) for f in fields(value)}
    raise TypeError(f"a {type(value).__name__} has no wire format")


def from_wire(wire: Any, connection: Connection | None = None) -> Any:
    if not isinstance(wire, dict):
        return wire
    kind = wire["$"]
    match kind:
        case "Model":
            return model_from_wire(wire["value"], connection)
        case "tuple":
            return tuple(from_wire(x, connection) for x in wire["items"])
        case "dict":
            return {k: from_wire(v, connection) for k, v in wire["items"]}
        case "datetime":
            return dt.datetime.fromisoformat(wire["value"])
        case "date":
            return dt.date.fromisoformat(wire["value"])
        case "timedelta":
            return dt.timedelta(*wire["value"])
        case "decimal":
            return Decimal(wire["value"])
        case "bytes":
            return bytes.fromhex(wire["value"])
    made = _classes().get(kind)
    if made is None:
        raise ValueError(f"unknown kind on the wire: {kind}")
    return made(**{k: from_wire(v, connection) for k, v in wire.items() if k != "$"})


_PARTS = ("source", "attributes", "measures", "relations", "primary_key", "activity", "meta")


def model_to_wire(model: Model) -> dict:
    """The model without its connection, whose data and secrets never leave the process."""
    return {"version": VERSION} | {part: to_wire(getattr(model, part)) for part in _PARTS}


def model_from_wire(wire: dict, connection: Connection | None = None) -> Model:
    from metricframe.model import Model

    if wire.get("version") != VERSION:
        raise ValueError(f"wire version {wire.get('version')} is not {VERSION}")
    return Model(connection=connection, **{part: from_wire(wire[part], connection) for part in _PARTS})


def same(a: ex.Expression, b: ex.Expression) -> bool:
    return to_wire(a) == to_wire(b)


def stable_hash(value: Any) -> str:
    from metricframe.model import Model

    wire = model_to_wire(value) if isinstance(value, Model) else to_wire(value)
    return hashlib.sha256(json.dumps(wire, sort_keys=True).encode()).hexdigest()
