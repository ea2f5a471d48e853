"""twinvec: tied-weight skip-gram embeddings and their subvector analytics on Spark.

Every operator takes and returns DataFrames; nothing is collected to the driver except
bounded metadata (counts, partition offsets, a few scalars).
"""

import sys as _sys

from twinvec.params import Word2VecParams

# Python UDFs (the scoring and training kernels) are shipped by value, so executors need
# neither this package installed nor the driver's working directory on their path.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

__all__ = ["Word2VecParams"]
