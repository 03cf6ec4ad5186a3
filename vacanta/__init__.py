"""Spark-native operators for job postings and a question/answer corpus."""
