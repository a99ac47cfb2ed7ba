"""Operators for large-scale training-data preparation.

Every public operator takes and returns Spark DataFrames.  The work runs in
Spark tasks: built-in expressions where they fit, Arrow batches and numpy where
a rule needs imperative code.  Nothing outside this subpackage imports it.
"""
