"""All of the core's queries: importing the modules enters them."""

from stallkit.plans import messages, pages, prices, scalars, searching, statistics, storage, taxonomy, verbs
from stallkit.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "messages", "pages", "prices", "scalars", "searching", "statistics", "storage", "taxonomy", "verbs"]
