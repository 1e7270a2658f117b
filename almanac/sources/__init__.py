"""Sources and sinks: raw tables, derived fixture views, landed JSON, text formats."""
