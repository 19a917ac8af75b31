"""Base tables and KPI reports."""
