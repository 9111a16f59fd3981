"""Operators of a training-data pipeline over documents and conversations.

Nothing outside this package imports it. Its functions travel with the tasks by
value, so executors need not have the package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
