"""Reading and writing of record tables."""
