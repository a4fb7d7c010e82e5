"""Interval-market analytics as Spark DataFrame jobs.

The library is a set of ``DataFrame -> DataFrame`` operators (``operators``),
``Column`` builders (``functions``), readers and writers (``sources``), composed
jobs (``plans``) and Structured Streaming jobs (``streaming``).
"""
