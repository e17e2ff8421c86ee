"""Column-level expression helpers."""

from carrisk.functions.scalar import *  # noqa: F401,F403
