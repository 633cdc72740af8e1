"""Registered queries: operators applied to the shared tables, beside their SQL twins."""
