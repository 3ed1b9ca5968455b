"""Readers and writers: VCF text, parquet tables, sample sheets, caches, TSV."""
