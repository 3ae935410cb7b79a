"""votepanel: PySpark-native election panel analytics (ingest, panel, forecast, evaluation)."""
