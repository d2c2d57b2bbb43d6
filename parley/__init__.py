"""parley: Spark operators for preparing chat and text corpora.

``sources``    readers and writers
``functions``  column expressions (turns, tokens, masks, arrays, vectors)
``operators``  DataFrame -> DataFrame steps
``plans``      whole flows put together from the operators
``catalog``    the registered queries and the SQL they are checked against
"""
