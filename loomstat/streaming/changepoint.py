"""Online change-point detection: the run-length filter of series.bcp_votes on a stream, with state for each series."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from math import lgamma
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series_id long, idx long, y double, run_length long, change_probability double"
STATE = "filter string"


def start() -> dict:
    return {"n": 0, "r": [1.0], "mu": [0.0], "kappa": [1.0], "alpha": [1.0], "beta": [4.0]}


def step(s: dict, x: float, hazard: float, keep: int | None) -> tuple[int, float]:
    """Take one value in; the likeliest run length and the probability of a change just now. At most keep run lengths stay in the state, if given."""
    r, mu, kappa, alpha, beta = (np.array(s[k]) for k in ("r", "mu", "kappa", "alpha", "beta"))
    nu, var = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
    const = np.exp([lgamma(v / 2 + 0.5) - lgamma(v / 2) for v in nu])
    grown = r * const / np.sqrt(nu * np.pi * var) * (1 + (x - mu) ** 2 / (nu * var)) ** (-(nu + 1) / 2)
    new = np.concatenate([[grown.sum() / hazard], grown * (1 - 1 / hazard)])
    new /= new.sum()
    first = start()
    after = {
        "r": new, "mu": np.concatenate([first["mu"], (kappa * mu + x) / (kappa + 1)]), "kappa": np.concatenate([first["kappa"], kappa + 1]),
        "alpha": np.concatenate([first["alpha"], alpha + 0.5]), "beta": np.concatenate([first["beta"], beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))]),
    }
    s.update({k: v[:keep].tolist() for k, v in after.items()})
    s["n"] += 1
    return int(np.argmax(s["r"])), float(s["r"][0])


def detect(stream: DataFrame, *, hazard: float = 500.0, keep: int | None = None) -> DataFrame:
    """(series_id, idx, y) as a stream of standardised values, to each value's likeliest run length.

    Values of a series are taken in order of idx within a micro-batch. The state of a series holds a number for each run
    length so far, as in the batch operator. Endless series can bound it by keep, which cuts longer runs off there.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, y in zip(rows.idx, rows.y, strict=True):
            length, p = step(s, float(y), hazard, keep)
            out.append((key[0], int(idx), float(y), length, p))
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["series_id", "idx", "y", "run_length", "change_probability"])

    return stream.groupBy("series_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
