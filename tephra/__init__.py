"""Spark-native dataflow for labelled structures, and a training-data pipeline in ``tephra.llm``."""
