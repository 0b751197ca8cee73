"""grantlens: access-governance analytics as Spark DataFrame jobs.

Who can reach what: group closures, effective rights on file-share resources,
unused access, directory inventories and data checks, all computed from
DataFrames with joins, aggregations and shuffles that Catalyst plans.
"""

from grantlens.session import build_session, ensure_checkpoint_dir
from grantlens.sources.catalog import GovernanceCatalog

__all__ = ["build_session", "ensure_checkpoint_dir", "GovernanceCatalog"]
