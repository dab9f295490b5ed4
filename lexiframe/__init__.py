"""Text-table enrichment on Spark: scans, table detection, normalisation,
token analysis, key phrases and job bookkeeping as DataFrame plans."""
