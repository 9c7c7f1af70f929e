"""Models outside of this library: a function from prompt to answer, called in batches, with waits between tries.

Answers are only proposals.  What may change a text is decided by the guards in ``quire.operators``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]
RETRIED = re.compile(r"429|500|503|quota|rate|overload|unavailable|resource_exhausted", re.I)


def with_retry(call: Model, tries: int = 6, wait: float = 15.0, longest: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """The call with up to ``tries`` more attempts after errors that pass, waiting twice as long each time."""

    def run(prompt: str) -> str:
        pause = wait
        for left in range(tries, -1, -1):
            try:
                return call(prompt)
            except Exception as e:
                if not left or not RETRIED.search(str(e)):
                    raise
                sleep(pause)
                pause = min(longest, pause * 2)
        raise AssertionError

    return run


def ask(rows: DataFrame, model: Model, key: str, prompt: str) -> DataFrame:
    """``key, answer, error``: one call a row, in the executors; an error is an answer too."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            answers, errors = [], []
            for p in d["p"]:
                try:
                    answers.append(model(p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({key: d["k"], "answer": answers, "error": errors})

    return rows.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"`{key}` {kind}, answer string, error string")
