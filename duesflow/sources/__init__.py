"""Readers of the monthly files and writers of tables and documents."""
