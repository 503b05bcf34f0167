"""driftlex: corpus-trend analytics as PySpark DataFrame transformations."""
