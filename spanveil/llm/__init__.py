"""Training-data operators: filters, joins, readers, packers, shards, sketches and classifiers.

Nothing outside this subpackage imports it.
"""
