"""Sources and sinks: warehouse tables, adapter views, CSV, JDBC, keyed tables."""
