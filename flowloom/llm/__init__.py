"""Corpus preparation operators for training data, each one a Spark job."""
