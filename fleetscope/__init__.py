"""Spark-native analytics over fleets of source repositories.

``functions``  Column -> Column expressions (text, secrets, paths, versions, urls, labels)
``operators``  DataFrame -> DataFrame operators, column names as parameters
``sources``    readers and text parsers that produce the fact tables, and the report sink
``plans``      whole-scan composition, the detector registry and the query catalogue
``streaming``  Structured Streaming variants of two batch operators
"""
