"""Readers and writers: triple text files, tagged triples, edge / vertex lists,
exported documents, and matrices derived from the parquet test tables."""
