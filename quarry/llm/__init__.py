"""Operators of a large-scale training-data pipeline (see README, "Training-data operators").

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
