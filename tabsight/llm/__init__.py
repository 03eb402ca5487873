"""Training-data operators: packing, scans, deduplication and text classifiers.

Nothing else in the library imports this package. Registered queries and
their SQL are in ``tabsight.llm.queries``.
"""
