"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from caseloom.plans import collections, diagnostics, evaluation, extended, forms, more, retrieval, text

QUERIES = text.QUERIES | retrieval.QUERIES | evaluation.QUERIES | more.QUERIES | extended.QUERIES | diagnostics.QUERIES | collections.QUERIES | forms.QUERIES
SQL = text.SQL | retrieval.SQL | evaluation.SQL | more.SQL | extended.SQL | diagnostics.SQL | collections.SQL | forms.SQL
