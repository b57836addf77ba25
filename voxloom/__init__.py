"""voxloom: Spark jobs that build, audit and evaluate multimodal utterance corpora.

Every operator is a function from DataFrames to DataFrames; sessions are always
passed in by the caller.
"""
