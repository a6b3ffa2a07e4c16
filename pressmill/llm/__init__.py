"""Operators for preparing large training corpora, and the queries that apply them.

Every operator takes and returns DataFrames.  Shared conventions:

* ``doc_id`` identifies a document and orders documents; a row without ``doc_id`` is passed through untouched by
  operators that compare documents.
* a null text is an empty text.
* columns other than those an operator names are never read, so extra columns with any name are harmless.
"""
