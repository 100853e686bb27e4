"""Repeated-measures (panel) analytics on Spark DataFrames.

Wide tables of subjects measured over several waves are cleaned, binned,
unpivoted and summarised with DataFrame operations; generalized linear models
are fitted by distributed aggregation; tests, residual diagnostics,
predictions and marginal effects come back as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions shipped to Python
# workers carry their code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
