"""Column-level helpers (``Column -> Column``)."""

from .columns import *  # noqa: F401,F403
