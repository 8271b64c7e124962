"""quern: a batch analytics engine expressed on the PySpark DataFrame API.

Subpackages: ``functions`` (column builders and aggregates with fixed NULL, type and division semantics), ``operators``
(relational and data-processing operators), ``sources`` (file formats and catalog), ``plans`` (ready-made queries and their
oracle SQL), ``streaming``.  ``quern.llm`` is optional: nothing else imports it.
"""

__version__ = "0.1.0"
