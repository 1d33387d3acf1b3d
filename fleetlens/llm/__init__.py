"""Training-data operators: chat formatting, tokenization, search, mixing,
classifiers, sharding and deduplication, each a Spark job over DataFrames.

Nothing else in the library imports this subpackage.
"""
