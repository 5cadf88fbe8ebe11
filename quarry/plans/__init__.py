"""Registered query plans: each builds one operator (or a composition) over
the Parquet tables of a scale-factor folder, next to the SQL that computes
the same result, for side-by-side checks."""

from quarry.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401
