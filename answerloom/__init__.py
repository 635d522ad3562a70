"""Answer-reuse analytics on Spark DataFrames.

Tables of questions, vectors, answers, documents and access logs go in; joins,
windows, aggregations and streaming jobs over them come out.
"""
