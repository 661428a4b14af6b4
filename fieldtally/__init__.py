"""Observation analytics on Spark: functions from DataFrame to DataFrame.

``functions``  Column -> Column building blocks,
``operators``  DataFrame -> DataFrame steps,
``sources``    readers, payload unpivot and sinks,
``plans``      whole pipelines made of the above.
"""
