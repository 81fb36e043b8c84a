"""quillsearch: full-text retrieval, ranking evaluation and corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors carry their code, so only the driver needs the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
