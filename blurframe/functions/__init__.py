"""Column expressions: hierarchies, intervals, sets and information loss."""

from .expressions import *  # noqa: F403
