"""Match and event analytics as Spark operators: functions from DataFrames to DataFrames."""
