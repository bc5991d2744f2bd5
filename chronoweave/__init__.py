"""Timeline analytics on PySpark: interval joins, time maps, projections, alignment and scoring."""
