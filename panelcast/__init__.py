"""panelcast: daily station-panel analytics as lazy Spark DataFrame transformations.

Layout
------
sources/    readers (yearly CSV families, SQL-dump text, geometry text) and sinks
functions/  stateless column expressions (text, dates, maths, encodings, rules)
operators/  DataFrame -> DataFrame operators (frames, fills, windows, joins,
            aggregates, profiling, imputation, spatial joins, modelling)
plans/      end-to-end flows and the query catalogue used by ``__spark_entry__``
streaming/  the stateless expressions applied to ``readStream`` frames
"""

__version__ = "0.1.0"
