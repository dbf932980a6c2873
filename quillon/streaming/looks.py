"""Sequential surveillance as state: each look at a key adds to its counts and is tested against the Poisson boundary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import trends

_STATE = "c long, mu double, looks int, max_llr double, last long, crossed boolean, first_crossing long"  # times in microseconds; no nulls, which do not come back from a state


def boundary(n: float, alpha: float = 0.05) -> float:
    """trends.critical_value of a number."""
    x, y = zip(*trends.critical_values(alpha))
    return float(y[-1] + trends.TAIL * np.log(n / x[-1]) if n > x[-1] else np.interp(n, x, y))


def sequential(rows: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """A row per key and look: counts and expectation so far, their log-likelihood ratio, the largest one so far, the
    boundary at the counts so far, and the first look at which it was crossed.

    `rows` is a stream of (key, look timestamp, n, expected), any number of rows a look; it comes look after look, and
    where the batches are cut makes no difference. Counts of a look that has been tested already are not lost: they
    join the next look. Null counts are none; rows without a look are refused. The state is seven values a key.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c, mu, looks, best, at, is_crossed, first = state.get if state.exists else (0, 0.0, 0, 0.0, 0, False, 0)
        last = pd.Timestamp(at, unit="us") if looks else None
        crossed = pd.Timestamp(first, unit="us") if is_crossed else None
        by: dict[pd.Timestamp, list[float]] = {}
        for part in parts:  # one entry a look, however many rows there are
            if part["look"].isna().any():
                raise ValueError(f"row without a look: {k[0]}")
            for look, g in part.groupby("look", sort=False)[["n", "expected"]].sum().iterrows():
                got = by.setdefault(look, [0.0, 0.0])
                got[0] += g["n"]
                got[1] += g["expected"]
        out = []
        for look in sorted(by):
            c, mu = c + int(by[look][0]), mu + by[look][1]
            if last is not None and look <= last:
                continue
            looks, last = looks + 1, look
            llr = c * np.log(c / mu) - (c - mu) if c > mu > 0 else 0.0
            best, cv = max(best, llr), boundary(c, alpha)
            if crossed is None and cv > 0 and best >= cv:
                crossed = look
            out.append((k[0], look, looks, c, mu, llr, best, cv, crossed))
        micros = lambda t: 0 if t is None else int(t.as_unit("us").asm8.view("i8"))
        state.update((c, float(mu), looks, float(best), micros(last), crossed is not None, micros(crossed)))
        yield pd.DataFrame(out, columns=[key, "look", "looks", "c", "mu", "llr", "max_llr", "critical", "first_crossing"]).astype({"look": "datetime64[us]", "first_crossing": "datetime64[us]"})

    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, look timestamp, looks int, c long, mu double, llr double, max_llr double, critical double, first_crossing timestamp"
    return rows.select(key, "look", "n", "expected").groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(rows: DataFrame, key: str, folder: str, alpha: float = 0.05) -> DataFrame:
    """Test all looks that are there and give those of all runs on the folder. A batch that is run again overwrites its
    own rows, and its state is that of the batch before."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/looks/batch={number:08d}")

    sequential(rows, key, alpha).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/looks").drop("batch")
