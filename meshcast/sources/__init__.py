"""sources of the sensor-grid library."""
