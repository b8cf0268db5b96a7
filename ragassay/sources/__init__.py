"""Readers, the versioned table folder and the CSV / JSON sinks."""
