"""functions of the sensor-grid library."""
