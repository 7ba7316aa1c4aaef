"""fleetlens: database-operations analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Instants are passed
in as ``as_of`` and fleet keys as ``by``; nothing runs until a sink or the
caller starts an action.
"""
