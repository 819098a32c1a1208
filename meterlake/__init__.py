"""meterlake: usage-log analytics and training-data operators as plain PySpark."""
