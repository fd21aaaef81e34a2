"""eospark: Spark jobs for Earth-observation example tables, predictions and metric logs."""
