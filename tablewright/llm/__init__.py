"""Operators for training-data pipelines (see README, "Training-data operators").

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the registered
``opN_<name>`` queries, which derive the digest columns from the operators.
"""
