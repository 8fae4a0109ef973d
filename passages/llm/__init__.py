"""Training-data operators over document tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it can be imported.  Executors must be able to import the package.
"""
