"""Ready-made queries over a data folder, with the same queries in SQL."""
