"""paperloom: document refinement and corpus preparation on Spark DataFrames.

Every operator takes and returns DataFrames or Columns.  Nothing in the core
imports the optional training-data package ``paperloom.llm``.
"""

__version__ = "0.1.0"
