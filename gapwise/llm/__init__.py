"""Operators for text collections used in model training.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
