"""plumbline: data-quality checks and statistical diagnostics as Spark jobs.

Every operator takes a DataFrame (or a :class:`plumbline.functions.series.Series`
built from one) and returns a tidy DataFrame.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python functions sent to tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
