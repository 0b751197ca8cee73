"""Training-data operators (language ID, near duplicates, decontamination, LM scoring, secrets, BPE, chat, quality, lines, ANN).

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
