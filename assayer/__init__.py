"""Spark-native evaluation of analytical query results.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers and writers), ``plans`` (query builders and
whole evaluation runs), ``streaming`` (live runs) and ``checks`` (the registry
of runnable queries with their SQL twins).
"""
