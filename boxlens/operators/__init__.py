"""Reusable DataFrame -> DataFrame operators shared by the reports."""
