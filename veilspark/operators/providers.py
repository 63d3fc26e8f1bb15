"""Pluggable planners: a callable answers prompts in batches inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.quality import repaired_actions
from veilspark.session import ship_package

Provider = Callable[[list[str]], list[str]]


def provider_actions(prompts: DataFrame, prompt: str, load_provider: Callable[[], Provider], *keys: str) -> DataFrame:
    """Action per prompt row from a provider's answers.

    ``load_provider`` runs once per task and gives a function from a list of
    prompts to a list of responses of the same length.  A failing batch, or one of
    another length, gives no responses: its rows have no action, an ``error``, and
    in ``failure`` what the provider raised.
    """
    ship_package(prompts.sparkSession)
    rows = prompts.select(*keys, F.col(prompt).alias("prompt"))
    schema = rows.drop("prompt").schema.add("response", "string").add("failure", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = load_provider()
        for batch in batches:
            failure = None
            try:
                answers = list(provider(batch["prompt"].tolist()))
                if len(answers) != len(batch):
                    raise ValueError(f"{len(answers)} answers to {len(batch)} prompts")
            except Exception as e:  # whatever it is, the other batches go on
                answers, failure = [""] * len(batch), f"{type(e).__name__}: {e}"
            yield batch.drop(columns="prompt").assign(response=answers, failure=failure)

    return repaired_actions(rows.mapInPandas(run, schema), "response", *keys, "failure")
