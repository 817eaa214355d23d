"""Résumé / job-description matching on Spark DataFrames."""
