"""Model terms as data: parsing, expansion to design columns, column expressions.

A term is a tuple of column names (their product). ``a*b`` stands for a + b + a:b and ``a:b`` for
the product alone; operands may themselves be products. Factors expand to treatment dummies.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = tuple[str, ...]
Atom = tuple[str, str | None]
DesignColumn = tuple[Atom, ...]


def parse(term: str) -> list[Term]:
    operands = [tuple(x.strip() for x in part.split(":")) for part in term.split("*")]
    out = []
    for size in range(1, len(operands) + 1):
        for chosen in combinations(operands, size):
            out.append(tuple(dict.fromkeys(x for op in chosen for x in op)))
    return out


def terms(names, columns: dict[str, str] | None = None) -> list[Term]:
    """Unique terms of a list of term strings, main effects before products of a higher order."""
    columns = columns or {}
    found = [tuple(columns.get(c, c) for c in t) for name in names for t in parse(name)]
    unique = {frozenset(t): t for t in reversed(found)}
    ordered = [t for t in dict.fromkeys(found) if unique[frozenset(t)] == t]
    return sorted(ordered, key=len)


def design(model: list[Term], level_map: dict[str, list[str]]) -> list[DesignColumn]:
    out: list[DesignColumn] = []
    for term in model:
        choices = [[(c, lvl) for lvl in level_map[c][1:]] if c in level_map else [(c, None)] for c in term]
        out += [tuple(p) for p in product(*choices)]
    return list(dict.fromkeys(out))


def label(column: DesignColumn) -> str:
    return ":".join(c if lvl is None else f"{c}={lvl}" for c, lvl in column)


def expression(column: DesignColumn) -> Column:
    parts = [F.col(c) if lvl is None else (F.col(c) == F.lit(lvl)).cast("double") for c, lvl in column]
    return reduce(lambda a, b: a * b, parts)


def vector(by_cluster: dict[int, list[DesignColumn]], cluster: str = "cluster", *, intercept: bool = True,
           width: int | None = None) -> tuple[Column, int]:
    """Design vector of each row, chosen by its stratum and padded with zeros to one width.

    Null when any of the stratum's own terms is null, so dropping nulls keeps complete cases.
    """
    lead = [F.lit(1.0)] if intercept else []
    width = width or max(len(d) for d in by_cluster.values()) + len(lead)
    out = None
    for c, columns in by_cluster.items():
        cells = lead + [expression(d) for d in columns]
        whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in cells])
        arr = F.when(whole, F.array(*cells, *[F.lit(0.0)] * (width - len(cells))))
        hit = F.col(cluster) == F.lit(c)
        out = F.when(hit, arr) if out is None else out.when(hit, arr)
    return out, width
