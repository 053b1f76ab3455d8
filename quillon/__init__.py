"""quillon: schedule, text and training-data operators as Spark DataFrame transformations."""
