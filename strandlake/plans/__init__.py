"""The queries and their SQL."""

from . import round_trips  # noqa: F401
