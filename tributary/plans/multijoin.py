"""Left-deep joins of many relations in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def left_deep(relations: dict[str, DataFrame], edges: dict[frozenset, Column], order: tuple[str, ...], hint: str | None = None) -> DataFrame:
    """Joins the relations one after the other, each on all edges to those before; a relation without an edge raises ValueError."""
    out, joined = relations[order[0]], [order[0]]
    for name in order[1:]:
        on = [edges[frozenset((name, j))] for j in joined if frozenset((name, j)) in edges]
        if not on:
            raise ValueError(f"{name} has no edge to {', '.join(joined)}")
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        right = relations[name]
        out = out.join(right.hint(hint) if hint else right, condition, "inner")
        joined.append(name)
    return out
