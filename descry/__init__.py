"""descry: Spark jobs for archives of network-telemetry documents.

Every operator is a function from DataFrames to a DataFrame.  Nothing in
``operators`` or ``functions`` reads or writes files, and nothing reads the
wall clock: jobs pass ``now`` in.
"""
