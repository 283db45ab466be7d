"""The history kept up to date from a folder of arriving logs."""
