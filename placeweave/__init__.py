"""Place descriptions evaluated as spatial expressions over whole tables, on Spark."""
