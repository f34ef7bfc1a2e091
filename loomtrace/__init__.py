"""Spark-native analytics over activity logs of coding agents, and corpus preparation for language models.

functions/  Column -> Column expression builders (text, path, shell, hash, time)
sources/    readers and the bridge from the driver's tables to canonical frames
operators/  DataFrame -> DataFrame operators (correlation, rules, usage, statistics)
plans/      registered queries and their SQL counterparts
streaming/  Structured Streaming forms
llm/        corpus preparation; nothing else in the package imports it
"""
