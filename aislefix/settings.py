"""Fixed values of the method, and the parameters a caller may change."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
SLOTS = 10
PAD = -999
EARTH_RADIUS_M = 6371 * 1000


@dataclass(frozen=True)
class Settings:
    """Parameters of the positioning method.

    The window is chosen by day of month: visits up to ``cutoff_day`` describe
    the shops, later ones are the labelled examples. Query rows are answered
    from the visits of all days.
    """

    cutoff_day: int = 24
    feature_days: int = 24
    answer_days: int = 31
    profile_min_support: int = 1
    index_min_support: int = 6
    train_width: int = 12
    answer_width: int = 15
    popular_width: int = 3
    # Which window's access point means the slot features of query rows use.
    answer_slot_window: str = "feature"


DEFAULTS = Settings()
