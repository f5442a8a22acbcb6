"""All query modules; importing this registers their queries."""

from . import aggregates, joins, rows, scans_sinks, sequences, stateful, streams

__all__ = ["aggregates", "joins", "rows", "scans_sinks", "sequences", "stateful", "streams"]
