"""Batch and streaming analytics for question-answering corpora, written as Spark jobs."""
