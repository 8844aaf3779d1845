"""sievemark: measurement and analytics over inspection records, on Spark.

Subpackages
-----------
``functions``  column expressions (text, keys, hashing, diffusion curves)
``sources``    readers and writers
``operators``  DataFrame -> DataFrame operators
``plans``      query catalogue, validation gate, pipeline, exhibits
``streaming``  Structured Streaming forms of the batch aggregates
``llm``        training-data operators (optional; nothing here imports it)
"""

__version__ = "0.1.0"
