"""clipweave: plan short vertical clips for large video collections with Spark.

Tables in, clip plans out.  Every operator is a function from DataFrames to a
DataFrame; nothing is decoded, rendered or sent to a model here.
"""

__version__ = "0.1.0"
