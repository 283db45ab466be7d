"""Writers for cleaned logs, records, crashes, mappings, pattern lists and small tables."""
