"""Tidemill: article and document analytics written as plain Spark DataFrame functions."""
