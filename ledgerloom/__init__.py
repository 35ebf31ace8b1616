"""Sales analytics as Spark DataFrame operators.

Every operator takes a ``sales`` DataFrame (one row per transaction line) and
returns a DataFrame.  Nothing is collected inside an operator, and every rule is
a built-in Spark expression, so a query stays one Catalyst plan from scan to
result.
"""
