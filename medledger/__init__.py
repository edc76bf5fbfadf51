"""medledger: clinical-operations reports, audits and ordered batch changes on Spark DataFrames."""

__version__ = "0.1.0"
