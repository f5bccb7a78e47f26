"""placestat: place-and-service analytics as plain PySpark DataFrame functions."""
