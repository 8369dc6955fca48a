"""Retrieval analytics as lazy Spark plans: scanning, chunking, lexical and dense ranking, fusion, review, evaluation and accounting."""
