"""Registration of queries with their SQL."""

from __future__ import annotations

from quarryline.plans.tables import bound


class Queries:
    def __init__(self):
        self.all: dict[str, tuple] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.all[name] = (f, bound(sql) if sql else None)
            return f

        return put
