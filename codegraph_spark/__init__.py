"""PySpark-native retrieval and analytics over code and document corpora.

Every operator is a function ``DataFrame(s) -> DataFrame``.  Requests come in
batches: a ``req`` DataFrame keyed by ``query_id`` holds many queries, seeds or
edits, and one Spark job answers them all.
"""

__version__ = "0.1.0"
