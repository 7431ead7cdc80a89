"""Where queries register, with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep
