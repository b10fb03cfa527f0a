"""Training-data operators over the synthetic text tables.

Nothing else in :mod:`sitewise` imports this subpackage; ``__spark_entry__``
adds its queries only when it can be imported.
"""
