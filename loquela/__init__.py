"""Loquela: a Spark-first engine for time-stamped, multi-source utterance analytics."""
