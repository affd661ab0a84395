"""heddle: dataset curation, streaming memory and evaluation analytics on Spark DataFrames."""

from heddle.session import cut, shared_dir, stage, table

__all__ = ["cut", "shared_dir", "stage", "table"]
