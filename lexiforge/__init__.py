"""Resolving noisy label text against a controlled vocabulary, on Spark."""

import os

# Numeric libraries take one thread each unless the environment says otherwise: Spark's tasks already use the cores, and
# threads of a library in a driver that starts processes may wait for ever. Holds where numpy isn't imported yet.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
