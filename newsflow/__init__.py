"""News-stream analytics written against the PySpark DataFrame API.

The package never creates a session: every entry point takes a DataFrame (batch
or streaming) or a session the caller owns.

``functions``  Column -> Column building blocks
``operators``  DataFrame -> DataFrame steps
``sources``    topics, feed files and views over the test tables
``sinks``      topic, collection and fan-out writers
``plans``      the five analyses, assembled from operators
``streaming``  the same five as Structured Streaming jobs
"""
