"""Retail commercial intelligence as Spark DataFrame jobs.

Every public operator is a function from DataFrames to a DataFrame.  All
tables carry a ``client_key`` column (one value per retailer) and every
operator answers for all retailers at once.
"""
