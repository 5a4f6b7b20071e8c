"""Reference SQL for the registered queries, as run by DuckDB.

``compose`` puts the common table expressions that a statement names, and
those they name in turn, in front of it.
"""

from __future__ import annotations

import re

from oracle.tables import TABLES


def compose(statement: str, extra: dict[str, str] | None = None) -> str:
    known = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in known and name not in ordered:
                add_one(name)

    def add_one(name: str) -> None:
        body = known[name]
        for other in re.findall(r"[a-z_0-9]+", body):
            if other in known and other != name and other not in ordered:
                add_one(other)
        if name not in ordered:
            ordered.append(name)

    add(statement)
    if not ordered:
        return statement
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{known[n]}\n)" for n in ordered) + "\n" + statement
