"""quarry: Spark-native data mining and automated modelling.

Sub-packages:

* ``sources``   -- file sources and sinks, preview and paging (A1-A8)
* ``functions`` -- scalar column expressions (tokens, bins, key hashes)
* ``operators`` -- profiling, row transforms, grouped statistics, text
                   features, preprocessing, validation, metrics, models,
                   search and explanation
* ``plans``     -- plot datasets and experiment/project compositions, plus the
                   registered query catalogue used by ``__spark_entry__``
* ``streaming`` -- applying fitted models to streaming DataFrames
"""

__version__ = "0.1.0"
