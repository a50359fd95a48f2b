"""Training-data operators: cleaning, deduplication, formatting, packing and sharding of text corpora.

Every operator is a function over DataFrames.  `votelens.llm.queries` registers one thin query per operator.
Nothing outside this subpackage imports it.
"""
