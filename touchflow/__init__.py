"""Customer-engagement analytics as Spark DataFrame operations.

Every public function takes DataFrames (batch or streaming) and returns DataFrames.  No session,
clock or path is hidden inside: callers pass ``as_of`` / ``now`` and locations explicitly.
"""
