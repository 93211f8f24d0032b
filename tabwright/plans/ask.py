"""Ad-hoc questions on a table, in Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabwright.operators.profile import overview

# A question of this form asks for the overview.
OVERVIEW_QUESTIONS = [
    r"\bdescribe\b.*\bdataset\b",
    r"\bdataset\b.*\bdescription\b",
    r"\bdataset\b.*\boverview\b",
    r"\bsummary\b.*\bdataset\b",
    r"\bwhat\s+is\s+the\s+description\s+of\s+dataset\b",
]


def is_overview_question(text: str) -> bool:
    return any(re.search(p, (text or "").strip().lower()) for p in OVERVIEW_QUESTIONS)


def ask(df: DataFrame, question: str, view: str = "data", limit: int | None = None, targets: Sequence[str] = ()) -> DataFrame:
    """The answer to a SQL statement over ``view``, or the overview if that is what is asked for."""
    if is_overview_question(question):
        return overview(df, targets)
    df.createOrReplaceTempView(view)
    answer = df.sparkSession.sql(question)
    return answer.limit(limit) if limit else answer
