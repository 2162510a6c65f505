"""Media-catalog analytics as Spark DataFrame jobs.

Tables in, tables out: listings, probe documents, the decision ledger and
encode progress events become plans, reports and alerts.
"""

__version__ = "0.1.0"
