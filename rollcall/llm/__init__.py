"""Training-data pipeline operators.

Each module holds one operator with its general interface and, next to it, the
registered query (``opN_<name>``).  ``registry`` gathers the queries and their
oracle SQL.  Nothing else in the library imports this package.
"""
