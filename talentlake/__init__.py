"""talentlake: job-search and hiring analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   – table scans, document/file admission, knowledge documents, queue streams
* ``operators`` – filters, joins, aggregations, ranking, sets, merges, vectors, work items
* ``functions`` – Column-returning helpers (salary, remote policy, labels, JSON, text)
* ``plans``     – career-shaped views over the test tables and the registered queries
* ``streaming`` – Structured Streaming twins of the batch operators
"""

from talentlake.session import checkpoint_root, get_session

__all__ = ["get_session", "checkpoint_root"]
