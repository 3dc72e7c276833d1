"""Log analytics and training-data operators on PySpark."""
