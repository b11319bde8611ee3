"""Spark jobs that turn collections of melody recordings into structured music tables."""

from melospark.shipping import ship

__all__ = ["ship"]
