"""tidelink: federated-data jobs on Spark.

Reads remote databases and catalog tables through a named source registry,
executes tables of query requests, joins remote rows with local ones, runs
keyed (repeatable) writes and constraint reports, and analyses the message
and log streams of the links in batch or with Structured Streaming.
"""

from tidelink.session import build_session, shared_dir
from tidelink.tables import TABLES, read_table, register_views

__all__ = ["TABLES", "build_session", "read_table", "register_views", "shared_dir"]
