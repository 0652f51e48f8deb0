"""streaming of the sensor-grid library."""
