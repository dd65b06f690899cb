"""tabwatch: Spark-native data preparation, evaluation and monitoring for tabular classifiers.

Every operator is a function ``DataFrame -> DataFrame`` built from DataFrame / SQL
primitives, generic over column names (see :mod:`tabwatch.spec`).
"""

from tabwatch.session import checkpoint_dir, get_session, materialize

__all__ = ["checkpoint_dir", "get_session", "materialize"]
