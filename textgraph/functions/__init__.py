"""Column builders: all of them JVM expressions."""

from .text import *  # noqa: F403
from .vectors import clamped_cosine

__all__ = ["clamped_cosine"]
