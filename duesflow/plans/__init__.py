"""The jobs a user calls: imports, billing, reports, notices."""
