"""siftline: record discovery and analytics as lazy Spark plans."""
