"""quirespark: document-processing analytics on PySpark.

``operators``  relational operators over text segments, runs, wallets and progress
``functions``  column-level text, quality and pricing functions
``sources``    readers and writers for pages, books and tables
``streaming``  keyed state: quotas, circuit breakers, holds
``plans``      the registered queries and their DuckDB twins
``llm``        training-data pipeline operators (nothing else imports it)
"""
