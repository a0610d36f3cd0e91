"""Scalar functions as Column expressions (all on the JVM)."""

from .scalar import *  # noqa: F403
