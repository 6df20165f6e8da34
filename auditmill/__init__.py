"""auditmill: security-event analytics over cloud audit logs, as Spark plans.

Every operator is a function ``DataFrame... -> DataFrame``.  Layout:

* ``sources``    readers and writers (audit JSON, parquet, CSV, reports, knowledge base)
* ``functions``  column expressions (strings, calendar, vectors, distributed ranks)
* ``operators``  normalisation, window features, models, alerts, enrichment, graph, text, evaluation
* ``streaming``  incremental versions of the same steps
* ``plans``      the registered queries over the test tables and their SQL counterparts
"""
