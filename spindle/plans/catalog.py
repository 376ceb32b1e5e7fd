"""All queries over the library's own operators."""

from __future__ import annotations

from spindle.plans import chats, code, more, repositories, routes, search, sources, texts  # noqa: F401  they register their queries
from spindle.plans.registry import QUERIES as QUERIES
from spindle.plans.registry import SQL as SQL
