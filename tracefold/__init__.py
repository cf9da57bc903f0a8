"""tracefold: Spark-native analytics over log records and agent-run event logs.

The library is a set of plain functions that take and return DataFrames:

* ``tracefold.sources``   — table derivation, record/SSE/CSV/artifact readers and writers
* ``tracefold.operators`` — record predicates and roll-ups, SQL guard and audit,
                            run-event folds, artifact bookkeeping, schema reports
* ``tracefold.functions`` — Column-level helpers (approvals, envelopes, usage, text)
* ``tracefold.streaming`` — Structured Streaming versions of the run/record folds
* ``tracefold.plans``     — the registry of named queries and their SQL twins
"""

__version__ = "0.1.0"
