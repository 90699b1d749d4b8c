"""shelfcast: retail demand forecasting and inventory planning on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` function.  Modules:

* ``sources``   - readers/writers, the driver-table adapter, table schemas
* ``functions`` - reusable column expressions (rounding, calendar, inventory math)
* ``operators`` - cleaning, quality checks, dimensions, SQL models, features,
                  forecasting, evaluation, inventory, analytics
* ``plans``     - composition of the operators into the nightly batch run and
                  the registry of named queries
* ``streaming`` - incremental (available-now) ingestion of new sales files
"""

__version__ = "0.1.0"
