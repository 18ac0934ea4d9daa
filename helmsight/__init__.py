"""Analysis of mobile-robot telemetry and command streams on Spark."""
