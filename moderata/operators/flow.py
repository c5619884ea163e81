"""One way for every message: gates -> route -> score -> quarantine.

Batch queries and the stream take the same steps, so no sink sees a message
that another one refused. A message whose scores failed reaches the quarantine
and nothing else; persona replies do not need scores and follow the routing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import routing as R

Scorer = Callable[[DataFrame], DataFrame]


class Flow(NamedTuple):
    routed: DataFrame      # passed the gates, not an image prompt
    scored: DataFrame      # with seven valid scores
    quarantine: DataFrame  # scores missing or not a number
    judged: DataFrame      # scored and quarantined together, told apart by ``routing.score_status``


def process(messages: DataFrame, scorer: Scorer, bot_user_id: int | None = None) -> Flow:
    routed = R.to_score(messages, bot_user_id)
    judged = scorer(routed)
    return Flow(routed, *R.split_quarantine(judged), judged)
