"""Fit / apply steps over wide frames: chains (P18) and routes of column groups
through their own steps (P17). A step's state is a small frame or plain
parameters; fitting sees only the train rows, applying sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass
class Step:
    """``fit(train rows, columns) -> state`` and ``apply(rows, state, columns)``.
    A step keeps all other columns of the frame (they pass through)."""

    fit: Callable[[DataFrame, list[str]], Any]
    apply: Callable[[DataFrame, Any, list[str]], DataFrame]


def apply_only(fn: Callable[[DataFrame, list[str]], DataFrame]) -> Step:
    """A step without state, such as a forward fill."""
    return Step(lambda df, cols: None, lambda df, state, cols: fn(df, cols))


def chain(steps: Sequence[Step]) -> Step:
    """Fit each step on what the steps before it made of the train rows."""
    def fit(df: DataFrame, cols: list[str]) -> list:
        states = []
        for s in steps:
            states.append(s.fit(df, cols))
            df = s.apply(df, states[-1], cols)
        return states

    return Step(fit, lambda df, states, cols: reduce(lambda x, p: p[0].apply(x, p[1], cols), zip(steps, states), df))


def route(groups: Sequence[tuple[Step, list[str]]]) -> Step:
    """Send each column group through its own step; other columns pass. A column
    in two groups, or in none of the frame's, is an error."""
    named = [c for _, cols in groups for c in cols]
    if len(named) != len(set(named)):
        raise ValueError(f"columns routed twice: {sorted({c for c in named if named.count(c) > 1})}")

    def fit(df: DataFrame, cols: list[str]) -> list:
        if missing := set(named) - set(df.columns):
            raise ValueError(f"columns not in the frame: {sorted(missing)}")
        return [s.fit(df, own) for s, own in groups]

    return Step(fit, lambda df, states, cols: reduce(lambda x, p: p[0][0].apply(x, p[1], p[0][1]), zip(groups, states), df))


def fit_apply(step: Step, df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """Fit on the ``train`` rows of ``df`` and apply to all of its rows."""
    return step.apply(df, step.fit(df.where(train), cols), cols)
