"""Training-data operators for large text corpora.

Nothing else in ``vectide`` imports this subpackage; it stands on PySpark, NumPy and PyArrow alone, so that it can be
taken out without touching the search engine.
"""
