"""typica: learn what typical text looks like, on Spark, and score departures from it.

Executors need no installed copy: the package's functions travel with the plans that use them.
"""

from pyspark import cloudpickle

import typica as _self

cloudpickle.register_pickle_by_value(_self)
