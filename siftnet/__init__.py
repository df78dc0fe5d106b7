"""siftnet: network and firewall telemetry as Spark DataFrames."""
