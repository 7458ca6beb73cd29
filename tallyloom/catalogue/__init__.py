"""Every operator as a named query over the shared tables."""

from tallyloom.catalogue import jobs, logs, models, profiles, retrievals, stored, texts
from tallyloom.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "jobs", "logs", "models", "profiles", "retrievals", "stored", "texts"]
