"""Batch and streaming analytics over language-model call logs, on Spark."""

from callscope.session import configure, durable

__all__ = ["configure", "durable"]
