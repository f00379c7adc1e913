"""tidewatch: time-series anomaly detection, predictive maintenance, survival, monitoring and graph analytics on Spark."""
