"""Account intelligence and training-data preparation on PySpark."""
