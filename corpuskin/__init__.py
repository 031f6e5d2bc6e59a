"""corpuskin: finding shared structure and shared bytes in corpora of files, on Spark DataFrames."""

__version__ = "0.1.0"
