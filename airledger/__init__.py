"""Analytics over the logs of two-way-radio sessions, as Spark DataFrame, SQL and streaming jobs."""
