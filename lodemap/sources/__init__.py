"""Sources and sinks of point maps, and views over the driver's tables."""
