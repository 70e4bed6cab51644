"""meridian: a PySpark-native engine for gridded wind fields, land masks and sea voyages."""
