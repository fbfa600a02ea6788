"""A PySpark library for text corpora, retrieval and the curation, scoring and evaluation of question data."""
