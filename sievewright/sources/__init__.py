"""Where tables come from and where state, outbox and held batches go."""

from .base import Source
from .catalog import CatalogSource
from .files import DirectorySource, FileSource
from .jdbc import JdbcSource

__all__ = ["Source", "CatalogSource", "FileSource", "DirectorySource", "JdbcSource"]
