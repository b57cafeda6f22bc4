"""Point-in-time analytics over ticker-tagged posts and price bars, on Spark."""
