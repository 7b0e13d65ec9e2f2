"""Every registered query of the engine with its SQL oracle."""

from tidewire.plans import (  # noqa: F401
    q_analysis,
    q_answers,
    q_api,
    q_history,
    q_intake,
    q_lists,
    q_ranking,
    q_relational,
    q_selection,
    q_series,
    q_similarity,
    q_stories,
    q_text,
    q_timers,
)
from tidewire.plans.base import ORACLES, QUERIES  # noqa: F401
