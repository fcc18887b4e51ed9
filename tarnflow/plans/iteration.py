"""Loops run by the driver: every round is a plan over frames cut to the shared folder; only states come back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tarnflow.storage import discard, materialize

#: Rounds after which a fixpoint puts what it knows together.
MANY = 16


def iterate(df: DataFrame, rounds: int, state, body: Callable[[DataFrame, object], DataFrame], fold: Callable[[DataFrame], object], update: Callable[[object, object], object], go_on: Callable[[object], bool] = lambda s: True) -> tuple[object, DataFrame]:
    """Feed the rows back through ``body`` at least once and at most ``rounds`` times; returns the state and the last rows.

    After each round ``fold`` makes a small delta of the rows, ``update`` puts it into the state and
    ``go_on`` decides, in this order.
    """
    last = None
    for _ in range(max(1, rounds)):
        df = materialize(body(df, state), "iterate")
        if last is not None:
            discard(last)
        last = df
        state = update(state, fold(df))
        if not go_on(state):
            break
    return state, df


def replay(df: DataFrame, rounds: int, state, body: Callable[[DataFrame, object], DataFrame], fold: Callable[[DataFrame], object], update: Callable[[object, object], object], go_on: Callable[[object], bool] = lambda s: True) -> object:
    """Put the same rows through ``body`` each round; only the state moves on."""
    kept = materialize(df, "replay")
    for _ in range(max(1, rounds)):
        state = update(state, fold(body(kept, state)))
        if not go_on(state):
            break
    return state


def delta_iterate(solution: DataFrame, delta: DataFrame, rounds: int, key: str, merge: Callable[[DataFrame], DataFrame], body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A solution set per key that deltas change, until none does or ``rounds`` have passed.

    ``delta`` has the key and updates. ``merge`` gets the full outer join of solution and delta on the key and
    returns the solution's columns and ``changed``; ``body`` turns the changed rows into the next delta.
    """
    names = solution.columns
    solution = materialize(solution, "solution")
    for _ in range(rounds):
        joined = solution.join(delta, key, "full")
        merged = materialize(merge(joined).select(*names, "changed"), "solution")
        discard(solution)
        solution = merged.drop("changed")
        changed = merged.where("changed").drop("changed")
        if changed.isEmpty():
            break
        delta = body(changed)
    return solution


def collect_state(df: DataFrame, **named):
    """A small state as a dictionary, from aggregates of the rows."""
    return df.agg(*[c.alias(n) for n, c in named.items()]).first().asDict()


def fixpoint(rows: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Add what ``step`` derives from the newest rows until nothing is new (semi-naive evaluation).

    What is known stays in the files of the rounds that found it, and is written anew only where they have become many.
    """
    parts = [materialize(rows.distinct(), "known")]
    new = known = parts[0]
    while True:
        new = materialize(step(known, new).distinct().join(known, known.columns, "left_anti"), "new")
        if new.isEmpty():
            return known
        parts.append(new)
        known = reduce(DataFrame.union, parts)
        if len(parts) == MANY:
            known = materialize(known, "known")
            discard(*[p for p in parts if p is not new])
            parts = [known]
