"""The query catalogue: importing it registers every query with its SQL."""

from . import aggregates, context, guards, metrics, panel, prepare, rows_only, sessions, splits  # noqa: F401
