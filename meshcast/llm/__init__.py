"""Training-data operators: one module each, plus `queries` with the registered queries.

Nothing else in the library imports this subpackage.
"""
