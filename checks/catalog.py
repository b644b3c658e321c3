"""All checks."""

from checks import q_alerts, q_lines, q_stream, q_windows  # noqa: F401
from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
