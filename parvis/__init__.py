"""Property-market analytics as Spark jobs.

Everything is a function ``DataFrame -> DataFrame`` meant for ``.transform``;
the only stateful objects are fitted models and encoding tables.
"""
