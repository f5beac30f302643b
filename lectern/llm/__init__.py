"""Operators for preparing large training corpora.

Nothing else in ``lectern`` imports this subpackage.  Shared conventions:

* A document is a row of a table with ``doc_id`` and ``text``.  Rows are
  identified by ``doc_id`` together with a hash of the text, so repeated rows
  and repeated ids never multiply or crash a join.
* Operators read only the columns they name, so extra columns (also ones whose
  names clash with a result column) never matter.
* Intermediate tables are written to the folder in ``spark.checkpoint.dir``.
"""
