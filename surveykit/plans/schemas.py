"""Stored output schemas of the contract queries, used to round the SQL twins' double
columns exactly like the Spark side (``contract_schemas.json`` is regenerated by
``python -m surveykit.plans.verify --write-schemas``)."""
from __future__ import annotations

import json
import os

_PATH = os.path.join(os.path.dirname(__file__), "contract_schemas.json")


def load() -> dict:
    if not os.path.exists(_PATH):
        return {}
    with open(_PATH) as f:
        return json.load(f)


def save(schemas: dict) -> None:
    with open(_PATH, "w") as f:
        json.dump(schemas, f, indent=1, sort_keys=True)


def _ident(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def wrap_rounding(name: str, sql: str, digits: int = 6) -> str:
    cols = load().get(name)
    if not cols:
        return sql
    sel = ", ".join(f"round({_ident(c)}, {digits}) AS {_ident(c)}" if t in ("double", "float")
                    else _ident(c) for c, t in cols)
    return f"SELECT {sel} FROM (\n{sql}\n) q"
