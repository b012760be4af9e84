"""tallyhouse: retail event analytics expressed as Spark DataFrames.

Layers
------
``schemas``    one unified EVENT schema, star-schema tables, vocabularies
``sources``    readers, and the projection of relational tables onto EVENT
``functions``  Column expressions: quality rules, predicates, keys, dates, JSON
``operators``  ``DataFrame -> DataFrame`` steps: clean, curate, features, aggregates, joins
``sinks``      file writers, keyed table, catalog loader
``plans``      batch run, warehouse DDL/DML, analytic views, reports
``streaming``  Structured Streaming job: event time, late data, keyed sinks
``queries``    named queries and their SQL oracles used by ``__spark_entry__``
"""

__version__ = "0.1.0"
