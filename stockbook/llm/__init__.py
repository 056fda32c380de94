"""Operators for building training corpora from documents.

Each module holds one operator with its general interface and a thin
``opN_<name>`` query over the generated tables; ``registry`` collects the
queries and their SQL. Nothing outside this package imports it.
"""
