from pagemill.sources.listing import list_paths
from pagemill.sources.sink import write_export

__all__ = ["list_paths", "write_export"]
