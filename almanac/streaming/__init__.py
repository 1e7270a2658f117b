"""Structured Streaming jobs (ST1-ST6): the scheduled polls of the reference re-aimed
as incremental queries with checkpoints in the shared checkpoint folder."""
