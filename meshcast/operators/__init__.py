"""operators of the sensor-grid library."""
