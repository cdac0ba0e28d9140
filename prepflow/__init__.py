"""Table preparation, reshaping and joining on Spark DataFrames.

Every operator is a plain function from DataFrames to DataFrames, usable with
``df.transform``.  The sub-packages are

* ``sources``   reading files, JDBC queries, text, media and images; writing results
* ``functions`` column expressions: text formulas, cleansing, dates
* ``operators`` table operators: filter, select, join, summarize, reshape, order, charts
* ``plans``     the operator registry and the JSON graph runner
* ``streaming`` running the stateless operators on streaming DataFrames
"""

__version__ = "0.1.0"
