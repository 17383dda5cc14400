"""rollcall: attendance and task-board analytics as Spark DataFrame operators.

Every operator is a DataFrame -> DataFrame function built from Spark's own
expressions.  Time-dependent operators take their "as of" instant as an
argument (a UTC ``timestamp_ntz``), so results are reproducible.
"""

__version__ = "0.1.0"
