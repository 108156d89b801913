"""depotlens: material-consumption analytics as plain Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, aggregates, joins and windows.  Analytics take ``by`` (a list of
grouping columns, e.g. ``["depot_name"]``) so one job computes every depot; an
empty ``by`` treats all rows as one group.
"""

__version__ = "0.1.0"
