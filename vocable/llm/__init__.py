"""Training-data pipeline operators.

One module per operator; :mod:`vocable.llm.queries` binds them to the tables
under the ``opN_<name>`` names.  Nothing outside this package imports it except
``__spark_entry__.py`` (guarded) and ``corpus_pipeline.py``.
"""
