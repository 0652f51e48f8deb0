"""plans of the sensor-grid library."""
