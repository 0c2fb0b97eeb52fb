"""Training-data pipeline operators.

Each module holds one operator with a general interface; ``registry`` holds
the thin ``opN_*`` queries that derive the contract's columns from it.
"""
