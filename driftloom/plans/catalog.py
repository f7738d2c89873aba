"""Named queries over the test tables and their SQL."""

from __future__ import annotations

from driftloom.plans import core, joins, more, tables

QUERIES: dict = {}
SQL: dict = {}
for _m in (core, joins, tables, more):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
