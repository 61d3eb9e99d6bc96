"""Millrace: an analytics engine for agent data, built on PySpark's DataFrame and SQL APIs."""

from millrace.operators.engine import Engine
from millrace.session import build_session

__all__ = ["Engine", "build_session"]
