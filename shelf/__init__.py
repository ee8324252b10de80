"""shelf: competitor-price benchmarking on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing runs until an
action is called, except where a docstring says that lineage is cut.
"""

__version__ = "0.1.0"
