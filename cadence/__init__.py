"""cadence: listening-history analytics as Spark DataFrame plans.

Every operator takes DataFrames and returns a DataFrame computed for all users
in one plan; ``user_id`` is always a grouping / partition key.
"""

__version__ = "0.1.0"
