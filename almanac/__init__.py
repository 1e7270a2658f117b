"""almanac: a Spark-native analytics engine for a personal multi-source event lake.

Telemetry snapshots, ledger transactions and media library / playback events are
modelled as DataFrames; every operator is a plain function ``DataFrame -> DataFrame``
built from Spark SQL built-ins so Catalyst can prune, push down and plan it.
"""

__all__ = ["session", "functions", "sources", "operators", "plans", "streaming"]
