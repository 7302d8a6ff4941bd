"""Importing this module registers every query."""

from testbed import q_joins, q_rules, q_sources, q_stats, q_streaming, q_windows  # noqa: F401

FLAGSHIP = "A1_run_summary"
