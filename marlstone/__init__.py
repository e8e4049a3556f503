"""Marlstone: schema-change analytics and data processing on PySpark DataFrames."""
