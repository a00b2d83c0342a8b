"""quirework: ordered-document dataflow on Spark.

Documents are tables of typed, positioned blocks; every stage is a lazy
``DataFrame -> DataFrame`` function that Catalyst plans as a whole.
"""
