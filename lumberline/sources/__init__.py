"""Readers: numbered log lines, archives, listings, module catalogs, pattern files and the stored history."""
