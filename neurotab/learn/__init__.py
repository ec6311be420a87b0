"""Distributed training and scoring (pyspark.ml) over feature vectors."""
