"""Driver queries over the given tables, each with its SQL twin."""

import sys

from pyspark import cloudpickle

# As in ``codelode``: worker functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    """All queries and all SQL twins."""
    from checks import q_chunks, q_context, q_files, q_lifecycle, q_retrieval  # noqa: F401
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
