"""Document-data operators for Spark: text to fields, review, events, streams."""
