"""moderata: message-moderation analytics on Spark.

Operators are DataFrame -> DataFrame functions in ``moderata.operators``;
sources, sinks and schemas in ``moderata.sources``; column helpers and fixed
values in ``moderata.functions``; streaming queries in ``moderata.streaming``;
the registered, oracle-checked queries in ``moderata.plans``.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: a cluster needs no
# copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
