"""Guards as data: formulas over test, features and opaque conditions.

A guard is JSON: true, false, "test", {"feature": name}, {"opaque": text}, {"not": g}, {"all": [g, ...]} or
{"any": [g, ...]}. Formulas repeat across many facts, so each distinct one of a batch is worked out once.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: The most atoms that a proof covers, and target keys that hold one value at a time.
MAX_ATOMS = 10
ONE_VALUE_KEYS = ("panic", "target_abi", "target_arch", "target_endian", "target_env", "target_os", "target_pointer_width", "target_vendor")


def atoms(guard) -> set[tuple[str, str]]:
    if isinstance(guard, bool):
        return set()
    if guard == "test":
        return {("test", "")}
    (kind, value), = guard.items()
    if kind in ("feature", "opaque"):
        return {(kind, value)}
    return set().union(*map(atoms, [value] if kind == "not" else value))


def evaluate(guard, known: dict[tuple[str, str], bool | None]) -> bool | None:
    """Kleene's logic: None is unknown."""
    if isinstance(guard, bool):
        return guard
    if guard == "test":
        return known.get(("test", ""))
    (kind, value), = guard.items()
    if kind in ("feature", "opaque"):
        return known.get((kind, value))
    if kind == "not":
        inner = evaluate(value, known)
        return None if inner is None else not inner
    parts = [evaluate(g, known) for g in value]
    decides = kind == "any"
    return decides if decides in parts else None if None in parts else not decides


def _column(guard, columns: dict, n: int) -> np.ndarray:
    """The guard's value in every row of a truth table."""
    if isinstance(guard, bool):
        return np.full(n, guard)
    if guard == "test":
        return columns["test", ""]
    (kind, value), = guard.items()
    if kind in ("feature", "opaque"):
        return columns[kind, value]
    if kind == "not":
        return ~_column(value, columns, n)
    start, join = (np.ones(n, bool), np.logical_and) if kind == "all" else (np.zeros(n, bool), np.logical_or)
    for g in value:
        start = join(start, _column(g, columns, n))
    return start


def satisfiable(guard) -> bool | None:
    """Whether some allowed assignment makes the guard true; None with more than MAX_ATOMS atoms."""
    names = sorted(atoms(guard))
    if len(names) > MAX_ATOMS:
        return None
    n = 1 << len(names)
    columns = {a: (np.arange(n) >> i & 1).astype(bool) for i, a in enumerate(names)}
    allowed = np.ones(n, bool)
    groups: dict[str, list] = {}
    for a in names:
        key, eq, _ = a[1].partition("=")
        if a[0] == "opaque" and eq and key in ONE_VALUE_KEYS:
            groups.setdefault(key, []).append(columns[a])
    for same in groups.values():
        allowed &= np.sum(same, axis=0) <= 1
    return bool((_column(guard, columns, n) & allowed).any())


def implies(a, b) -> bool | None:
    """Whether a makes b true in every allowed assignment; None if that isn't known."""
    if a == b:
        return True
    found = satisfiable({"all": [a, {"not": b}]})
    return None if found is None else not found


def _each(series: pd.Series, work) -> pd.Series:
    return series.map({g: None if g is None else work(json.loads(g)) for g in series.unique()}).astype(object)


def is_satisfiable(guard: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(g: pd.Series) -> pd.Series:
        return _each(g, satisfiable)

    return run(guard)


def guard_value(guard: Column, test: bool | None = None, features: list[str] | None = None) -> Column:
    """The guard where test has a value and, with an exact world, the features named are all there are; opaque
    conditions are always unknown. null: unknown."""

    class Known(dict):
        def get(self, key, default=None):
            kind, name = key
            return test if kind == "test" else None if kind == "opaque" or features is None else name in features

    @F.pandas_udf("boolean")
    def run(g: pd.Series) -> pd.Series:
        return _each(g, lambda x: evaluate(x, Known()))

    return run(guard)


def overlaps(a: Column, b: Column) -> Column:
    """Whether both guards can hold at once; unknown counts as yes."""
    both = F.concat(F.lit('{"all": ['), a, F.lit(", "), b, F.lit("]}"))
    return F.coalesce(is_satisfiable(both), F.lit(True))
