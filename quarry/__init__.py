"""quarry — Spark-native operators for instruction-data preparation and generated-text evaluation.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with ``df.transform``) built
from the public DataFrame / SQL / Structured Streaming API.  Operator ids (P4, J2, A2, ...) refer to
"""

__version__ = "0.1.0"
