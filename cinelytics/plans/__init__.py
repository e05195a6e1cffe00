"""Physical-plan helpers: size-checked joins and distributed ranking."""

from .joins import fits_broadcast, is_in_dimension, join_dimension  # noqa: F401
from .ranking import global_rank  # noqa: F401
