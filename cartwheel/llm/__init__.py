"""Operators for building training corpora: URL rules, HTML text, language, tokens, dedup, decontamination, PII, mixing, spelling variants, token alignment.

Nothing else in the library imports this subpackage.  Each operator has a general
interface (any DataFrame, column names as arguments); ``queries`` holds the thin
driver queries ``op1_… op13_…`` and ``oracles`` their DuckDB SQL.  Kernels that run in
tasks are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
