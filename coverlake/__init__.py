"""coverlake: option-panel cleaning and prediction-interval analytics on Spark.

Every public operator is DataFrame in, DataFrame out.  Sub-packages:

* ``sources``    -- table readers, fixture views, file and table sinks
* ``functions``  -- Column-expression builders (stay inside codegen)
* ``operators``  -- joins, filters, aggregations, binning, splits, models
* ``plans``      -- end-to-end jobs composed from operators
* ``streaming``  -- incremental (Structured Streaming) ingestion
"""

__version__ = "0.1.0"
