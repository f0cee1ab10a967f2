"""leadloom: prospect data as Spark jobs.

Award notices, registry payloads, company pages and outreach events come in as
tables; scored, ranked and suppressed prospects come out as tables.  Every
operator is a function from DataFrames to a DataFrame, ``as_of`` and ``play``
are always arguments, and nothing is collected to the driver.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its few Python functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
