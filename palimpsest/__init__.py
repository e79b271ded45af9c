"""palimpsest: versioned, content-addressed datasets as Spark plans.

``operators``  diff, merge, history, garbage collection, segmentation
``functions``  column expressions: hashes, grammars, codecs
``plans``      snapshot catalog with optimistic commits
``sources``    table loading and the snapshot data source
``streaming``  commit journal on Structured Streaming
``llm``        training-data operators; nothing else imports it
"""
