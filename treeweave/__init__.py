"""Spark jobs that turn tables of repository files, commits and requests into filtered text corpora."""
