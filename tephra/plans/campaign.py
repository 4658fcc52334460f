"""Rounds of choosing, labelling and fitting again: the loop is on the driver, what it moves are tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import written


@dataclass(frozen=True)
class Round:
    """What a round began with and took."""

    labelled: int
    error: float
    picked: DataFrame | None


def run_campaign(
    seed: DataFrame,
    *,
    key: str,
    pool: Callable[[Any, int], DataFrame],
    pick: Callable[[DataFrame, DataFrame, Any, int], DataFrame],
    label: Callable[[DataFrame], DataFrame],
    fit: Callable[[DataFrame], Any],
    error: Callable[[Any], float],
    held_out: DataFrame,
    rounds: int,
    per_round: int,
) -> tuple[Any, list[Round]]:
    """(model, rounds): fit the seed set, then in each round pool(model, round), pick(pool, train, model, n), label, and fit the union.

    Rows of a held-out key are never offered, nor rows that are labelled already. A pick outside the pool, or of more rows
    than asked for, is an error. An empty pool ends the rounds.
    """
    train = written(seed, "train")
    start = train.count()
    model = fit(train)
    done = [Round(0, error(model), None)]
    for number in range(rounds):
        fresh = pool(model, number).join(held_out.select(key), key, "left_anti").join(train.select(key), key, "left_anti")
        offered = written(fresh, "pool")
        if offered.isEmpty():
            break
        chosen = written(pick(offered, train, model, per_round), "picked")
        if chosen.count() > per_round or not chosen.join(offered.select(key), key, "left_anti").isEmpty():
            raise ValueError("a pick must be of the pool, and of no more rows than asked for")
        train = written(train.unionByName(label(chosen).select(*train.columns)), "train")
        model = fit(train)
        done.append(Round(train.count() - start, error(model), chosen))
    return model, done


def largest_deviation(rows: DataFrame, structure: str, std: str) -> DataFrame:
    """(structure, most): the largest deviation of any of a structure's rows, NaN ones left out."""
    return rows.where(~F.isnan(std)).groupBy(structure).agg(F.max(std).alias("most"))
