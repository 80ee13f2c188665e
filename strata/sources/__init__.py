"""Sources and sinks: file readers (batch and stream), rescue of misfit
values, ingest metadata, table writers."""
