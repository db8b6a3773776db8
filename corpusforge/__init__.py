"""corpusforge: a PySpark-native crawl-to-corpus engine.

Worker functions are pickled by value, so executors need neither this package
on their path nor a shipped archive.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
